"""Null and repeated doc_ids, stage by stage."""

import corpus_pipeline as p
from fernwave.llm import decontam, mixing

A, B, C, D = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey", "north south east west up down")


def test_one_of_each_class_stays(spark):
    rows = [(1, A, "s"), (1, A, "s"), (1, A, "r"), (2, A, "s"), (None, A, "s"), (None, B, "s"), (None, B, "s"), (None, C, "s"), (3, C, "s"), (4, B + " x", "s"), (4, D, "s"), (None, "", "s"), (None, "", "s"), (5, None, "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = p.jaccard_join(spark, docs, "").collect()
    want = [(1, A, "r"), (None, B, "s"), (3, C, "s"), (4, B + " x", "s"), (4, D, "s"), (None, "", "s"), (None, "", "s"), (5, None, "s"), (6, "", "s")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert got[0].__fields__ == docs.columns


def test_clean_documents_with_a_null_id_outlive_a_contaminated_one(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame([(None, item), (None, A), (1, item), (1, B), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(tuple, decontam.decontaminate(docs, benchmark).collect()), key=str) == sorted([(None, A), (1, B), (2, None)], key=str)


def test_mix_gives_every_row_once(spark):
    rows = [(1, A, "s")] * 3 + [(None, B, "s")] * 2 + [(None, C, None), (7, "", "s"), (7, "", "s"), (7, None, "s"), (None, "", "s"), (None, "", "s"), (8, D * 200, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.source) for r in mixed), key=str) == sorted(((d, s) for d, _, s in rows), key=str)
    out = p.source_mix(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in out), key=str) == sorted(rows, key=str)
    assert sorted(r.taken for r in out) == sorted(r.taken for r in mixed)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 256


def test_every_stage_keeps_columns_whose_names_clash(spark):
    names = "size long, row string, no long, of long, _row long, _key string, _stay long, spans string, added string, base string, c string, at long, window string, taken long, score double, lang_pred string"
    some = (7, "r", 8, 9, 10, "k", 11, "sp", "ad", "ba", "cc", 12, "win", 13, 0.5, "xx")
    rows = [(1, A, "en", "s", len(A), *some), (2, B + " mail a@b.cd", "en", None, 5, *some), (None, C, None, "s", None, *some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + names)
    benchmark = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(13)))], "item_id long, text string")
    for stage in (p.language_id, p.jaccard_join, lambda s, d, _: decontam.decontaminate(d, benchmark), p.personal_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 3
    out = p.source_mix(spark, docs, "")
    assert sorted(out.columns) == sorted({*docs.columns, "size", "source_size", "target", "taken"})
    assert sorted(r["size"] for r in out.collect()) == [6, 6, 8] and {r["row"] for r in out.collect()} == {"r"}


def test_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for stage in (p.language_id, p.jaccard_join, lambda s, d, _: decontam.decontaminate(d, benchmark), p.personal_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert p.source_mix(spark, docs, "").count() == 0


def test_nulls_and_very_long_texts_pass_every_stage(spark):
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)) + " "
    long *= 3000
    docs = spark.createDataFrame([(1, long, "en", "s", None), (2, long + "x", "en", "s", None), (3, None, None, None, None), (None, A, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    one = p.language_id(spark, docs, "")
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "None"]
    two = p.jaccard_join(spark, one, "")
    assert sorted(str(r.doc_id) for r in two.collect()) == ["1", "None"]
    four = p.personal_data(spark, decontam.decontaminate(two, benchmark), "")
    assert sorted(r["size"] for r in p.source_mix(spark, four, "").collect()) == [6, 120_000]
