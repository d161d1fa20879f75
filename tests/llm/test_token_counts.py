from collections import Counter

from fernwave.llm import token_counts as tc

SCHEMA = "doc_id long, text string, length long, n_docs long"


def test_sums_match_brute_force(spark):
    texts = [None, "", "a", "hello world", "hello world", "word " * 3000, "x" * 50_000, "é😀 \n\n  tabs\t", "one two three"] + ["tok " * k for k in range(0, 60, 7)]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    e = tc.load_encoding(open(tc.VOCABULARY, "rb").read())
    n = [len(e.encode_ordinary(t or "")) for t in texts]
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)
    h = tc.length_histogram(docs)
    assert {r.length: r.n_docs for r in h.collect()} == Counter(n)
    sums = tc.suffix_sums(h)
    for r in sums.collect():
        assert (r.docs_from, r.tokens_from) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length))
        assert r.truncated_total == sum(min(x, r.length) for x in n) and r.cut_docs == sum(x > r.length for x in n)
        assert abs(r.quantile - sum(x <= r.length for x in n) / len(n)) < 1e-12
    limits = spark.createDataFrame([(k,) for k in (0, 1, 5, 100, 10**6, 5)], "context_limit long")
    for r in tc.at_limits(sums, limits).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in n) and r.docs_from == sum(x >= r.context_limit for x in n)


def test_empty_table(spark):
    assert tc.suffix_sums(tc.length_histogram(spark.createDataFrame([], SCHEMA))).count() == 0
