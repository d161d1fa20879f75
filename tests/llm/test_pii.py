import hashlib
import re

from fernwave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    nums = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (CARD, lambda m: 13 <= len(nums(m)) <= 19 and luhn(nums(m))),
        "phone": (PHONE, lambda m: 9 <= len(nums(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in p.finditer(text) if ok(m.group())] for k, (p, ok) in rules.items()}


TEXTS = [
    None, "", "a", "@", "x@y.z", "x@y.z%foo@bar.com", "a@b.c..d@e.f", "a@b.c.d-@e.f", "über@mail.de ü@x.y", "a@b a@.b a@b. a@b.c.",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255 0000001.2.3.4 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112",
    "x4111111111111111y 4111  1111 1111 1111", "79927398713 4222222222222", "+44 20 7946 0958", "+1 (555) 010-9999.", "+1", "++12345678901", "+123456789012345678",
    "😀 mail 😀a.b@c.de 😀 +49 30 1234567", "a" * 3000 + "@" + "b." * 3000, "1" * 5000, "1 " * 5000, "1." * 5000, "+" * 2000, "+1" + "(" * 3000 + "5",
    "call 020 7946 0958 or bob (at) mail (dot) com",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        r = rows[i]
        flat = ",".join(f"{k}:{a}:{z}" for k, v in want.items() for a, z in v)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], t
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest(), t
        assert set(flat.split(",")) - {""} <= set(r.spans.split(","))


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    rows = [(1, "mail a@b.cd now", 15, "k"), (2, None, None, None), (3, "clean é", 7, "k"), (3, "clean é", 7, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    out = sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in out] == [(1, "mail [EMAIL] now", 16, "k"), (2, None, None, None), (3, "clean é", 7, "k"), (3, "clean é", 7, "k")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(docs).count() == 0
    assert pii.redact(docs).count() == 0


def test_boosting_learns_a_rule():
    import numpy as np

    g = np.random.default_rng(0)
    x = g.integers(0, 4, (400, len(pii.FEATURES)))
    y = ((x[:, 1] >= 2) & (x[:, 4] >= 1)).astype(float)
    s = pii.scores(pii.boost(x, y, np.ones(400)), x)
    assert ((s > 0) == (y > 0)).all()


def test_column_scores_equal_numpy_scores(spark):
    import numpy as np
    from pyspark.sql import functions as F

    g = np.random.default_rng(1)
    x = g.integers(0, 5, (60, len(pii.FEATURES)))
    trees = pii.boost(x, g.integers(0, 2, 60).astype(float), np.ones(60), 5)
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in x], [*pii.FEATURES])
    got = df.select(*pii.FEATURES, pii.score_column(trees, F.struct(*pii.FEATURES)).alias("s")).collect()
    for r in got:
        assert abs(r.s - pii.scores(trees, np.array([list(r)[:-1]]))[0]) < 1e-9
