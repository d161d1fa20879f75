import hashlib
import uuid

from fernwave.llm import warc
from fernwave.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, header string, digest string, payload string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "d", "p") for r in rows], SCHEMA)


def test_records_are_read_back(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "x" * 999), (5, "u5", "x" * 999), (6, "u6", None), (7, "u7", ""), (8, "a\r\nb: c", "y" * 200_000), (9, "z", "w" * 1000), (9, "z", "w" * 1000)]
    got = sorted(map(tuple, warc.archive_roundtrip(table(spark, rows)).drop("url").collect()))
    last = {1: 3, 2: 3}
    want = sorted(
        (p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if p in last else "response", last.get(p)) for p, _, h in rows
    )
    assert got == want
    assert warc.archive_roundtrip(table(spark, [])).count() == 0


def test_payloads_once_and_records_whole(spark):
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    rows = [(i, f"http://h/{i}", "same " * 300) for i in range(20)] + [(20, "q", "tiny")]
    warc.write_archive(table(spark, rows), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    whole = [bytes(r.record) for r in warc.reconstruct(spark, path).collect()]
    assert len(whole) == 21 and sum(b"same same" in w for w in whole) == 1
    for w in whole:
        head, _, rest = w.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(rest) - 4 == int(fields[b"Content-Length"]) and rest.endswith(b"\r\n\r\n")
