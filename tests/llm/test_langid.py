import random
import zlib

from fernwave.llm import langid

LETTERS = {"aa": ["ka", "to", "ni", "ra", "mo"], "bb": ["scht", "öl", "ung", "ver", "ein"], "cc": ["ción", "que", "ñ", "dad", "los"]}


def corpus(n, seed=0):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        lang = g.choice(list(LETTERS))
        words = ["".join(g.choice(LETTERS[lang]) for _ in range(g.randint(1, 3))) for _ in range(g.randint(5, 80))]
        rows.append((i, " ".join(words), lang, "s", 1.5, "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(600) + [(1000, None, "aa", None, None, None), (1001, "", None, "", 0.0, ""), (1002, "123 ... 456", "bb", "s", 0.0, ""), (1003, "ka" * 100_000, None, "s", 0.0, ""), (1004, "ka to", None, "s", 0.0, ""), (1004, "ka to", None, "s", 0.0, "")]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), per_language=200, steps=150).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:600]}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    for d in (1000, 1001, 1002):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[1003].lang_pred == "aa"


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", None, None, None, None), (None, "abc", None, None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_accepted_keeps_columns_and_clean_rows(spark):
    rows = corpus(300) + [(1000, "...", "aa", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = langid.accepted(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(300))


def test_tables_of_pairs_respond_like_the_filters():
    import numpy as np

    g = np.random.default_rng(0)
    x = g.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    tables = {w: g.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS}
    model = langid.Model(["a", "b", "c"], tables, g.normal(0, 1, (langid.FILTERS * len(langid.WIDTHS), 3)).astype(np.float32), g.normal(0, 1, 3).astype(np.float32))
    plain = np.zeros((70, len(langid.WIDTHS), langid.FILTERS))
    for n, w in enumerate(langid.WIDTHS):  # a convolution over one-hot bytes, place by place
        plain[:, n] = np.max([sum(tables[w][j][x[:, p + j]] for j in range(w)) for p in range(langid.WINDOW - w + 1)], axis=0)
    want = langid.softmax(np.maximum(plain.reshape(70, -1), 0) @ model.out + model.bias)
    assert np.allclose(langid.Predictor(model).probabilities(x), want, atol=1e-4)
    assert np.allclose(langid.respond(model, x), plain.reshape(70, -1), atol=1e-4)


def test_the_sample_is_bounded_and_holds_every_label_that_it_can(spark, monkeypatch):
    rows = [(i, f"word {i} " * 5, "zz" if i % 10 == 0 else "yy" if i % 3 else "xx", None, None, None) for i in range(900)] + [(1000, "seldom", "rare", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    drawn = lambda **how: {r.lang: r["count"] for r in langid.sample_windows(docs, each=1, **how).groupBy("lang").count().collect()}
    got = drawn(in_all=40)
    assert set(got) == {"xx", "yy", "zz", "rare"} and sum(got.values()) <= 40 and got["rare"] == 1
    assert set(drawn(in_all=2)) <= {"xx", "yy"} and sum(drawn(in_all=2).values()) <= 2  # the most frequent
    many = drawn(per_language=60)
    assert all(30 < many[k] < 90 for k in ("xx", "yy", "zz"))


def test_null_equal_and_copied_rows_leave_a_bounded_draw(spark, monkeypatch):
    """Neither ids that say nothing nor a text that fills the table empty the draw or blow it up; no lettered document goes."""
    monkeypatch.setattr(langid, "IN_ALL", 60)
    rows = corpus(300)
    for ids in (lambda i: None, lambda i: 7, lambda i: 1):
        docs = spark.createDataFrame([(ids(r[0]), *r[1:]) for r in rows] + [(ids(0), "...", "aa", None, None, None)], SCHEMA)
        drawn = langid.sample_windows(docs.select("doc_id", "text", "lang"), each=1).groupBy("lang").count().collect()
        assert sum(r["count"] for r in drawn) <= 60 and {r.lang for r in drawn if r["count"] > 5} == set(LETTERS)
        assert langid.accepted(docs).count() == 300
    copies = spark.createDataFrame([(7, "ka to ni ra mo", "aa", None, None, None)] * 500 + rows[:100], SCHEMA)
    drawn = langid.sample_windows(copies, each=1).collect()
    assert len(drawn) <= 60 and {r.lang for r in drawn} == set(LETTERS)
    assert langid.accepted(copies).count() == 600
