"""A content-addressed WARC archive: payloads once by verified digest, headers apart, records by joins.

Two Parquet tables make an archive. `payloads` holds each distinct payload once under its SHA-256; `records` holds
every record's exact header block, and the digest by which its payload is found. A null payload is an empty one, a
null URL an empty one; repeated rows give a record each, a null page_id too. The largest page_id of those that share a
payload of `least` bytes or more is the response; ties (repeated rows) are settled so that each of the equal rows is
that response. Columns besides page_id, url and html are not read. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_dir

LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
EOL = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(kind: str):
    """The header block of a record, as columns: exact text, CRLF line ends, a blank line last."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes").cast("string")),
    ]
    if kind == "revisit":
        lines += [
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.concat(F.lit("WARC-Refers-To: "), urn(F.col("response_id"))),
        ]
    lines += [
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + (F.lit(0) if kind == "revisit" else F.col("n_bytes"))).cast("string")),
    ]
    return F.concat(*[x for line in lines for x in (line, F.lit(EOL))], F.lit(EOL))


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write `path`/payloads and `path`/records.

    Payloads meet by digest only; tasks keep one payload for each digest before they shuffle, so a payload that a
    third of all pages share crosses the network once for each task.
    """
    named = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keyed = named.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    light = keyed.withColumn("sha1", F.sha1("payload")).select("page_id", "url", "digest", "n_bytes", "sha1")
    newest = light.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("response_id"))
    # Written first: what it is joined with can then be split where very many pages share a payload.
    joined = light.join(durable(newest), "digest", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    joined.select(F.when(revisit, _header("revisit")).otherwise(_header("response")).alias("header"), "digest").write.parquet(f"{path}/records")


def field(name: str, pattern: str = r"[^\r\n]*"):
    """A header field's value, or '' where the header lacks it."""
    return F.regexp_extract("header", rf"\r\n{name}: ({pattern})\r\n", 1)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with what is computed anew from the stored bytes; a digest that no longer holds is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.sha1("payload"))
    return stored.select(
        "digest",
        "payload",
        F.coalesce(checked, F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("string")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its header parsed, its payload's facts taken from the bytes that are stored."""
    # The payload bytes stay on their side: facts are computed once for each payload, then joined to the headers.
    facts = read_payloads(spark, path).drop("payload")
    page = lambda name: F.nullif(field(name, "<urn:page:[^>]*>"), F.lit(""))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return (
        spark.read.parquet(f"{path}/records")
        .join(facts, "digest")
        .select(
            number(page("WARC-Record-ID")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            field("WARC-Type").alias("record_type"),
            number(F.coalesce(page("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
            field("WARC-Target-URI").alias("url"),
        )
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(header, record): the exact bytes of every record; a revisit's block ends after its HTTP header."""
    is_revisit = field("WARC-Type") == "revisit"
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    end = F.encode(F.lit(EOL + EOL), "utf-8")
    both = spark.read.parquet(f"{path}/records").join(read_payloads(spark, path), "digest")
    return both.select("header", F.concat(F.encode("header", "utf-8"), F.encode(F.lit(HTTP), "utf-8"), body, end).alias("record"))


def archive_roundtrip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, least)
    return read_records(spark, path)
