"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, importance, langid, media, mixing, pii, rules, simjoin, substrings, token_counts, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.facts(media.store(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.dedup(table(spark, sf_dir, "documents")))


def op4_chat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(hard).alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(given.unionByName(probe)))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(table(spark, sf_dir, "pages")).drop("url")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.similarity_classes(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.verdicts(table(spark, sf_dir, "documents")).select(*base, "n_lines", "n_lettered", "n_shouted", "failed", "policy")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_media_columns,
        op3_substring_dedup,
        op4_chat_roundtrip,
        op5_source_mix,
        op6_decontamination,
        op7_warc_archive,
        op8_jaccard_join,
        op9_personal_data,
        op10_length_histogram,
        op11_fill_in_middle,
        op12_quality_rules,
        op13_importance_resampling,
    )
}

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    bool_or(contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')) AS hard,
    sum(length('[INST]' || CASE WHEN regexp_full_match(role, '[A-Za-z0-9_]+') THEN role ELSE '=' || base64(encode(role)) END || chr(10) || '</s>')) AS frame,
    sum(length(text)) AS plain,
    sum(length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))) AS broken
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(3 + frame + CASE WHEN hard THEN 1 + broken ELSE plain END AS BIGINT) AS formatted_chars
FROM g
"""

OP6 = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, w[i:i + least(13, len(w)) - 1] AS ws
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS u(i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, w[i:i + k - 1] AS ws FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i)
), m AS (
  SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.ws = bw.ws
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + k - 1)) AS u(p) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7 = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, doc_id, i, b[i:i + 49] AS s FROM d, unnest(generate_series(1, octet_length(b) - 49)) AS u(i)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT k, i FROM w JOIN f USING (s) WHERE f.least < w.doc_id OR (w.doc_id IS NULL AND f.least IS NOT NULL)),
e AS (SELECT k, i, i > coalesce(lag(i) OVER (PARTITION BY k ORDER BY i) + 50, 0) AS new FROM hit),
g AS (SELECT k, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY k ORDER BY i) AS run FROM e),
r AS (SELECT k, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY k, run),
kept AS (SELECT k, a AS upto, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 1) AS since FROM (SELECT k, a, z FROM r UNION ALL SELECT k, octet_length(b) + 1, NULL FROM d)),
h AS (SELECT k, string_agg(CASE WHEN upto > since THEN hex(b[since:upto - 1]) ELSE '' END, '' ORDER BY since, upto) AS kept FROM kept JOIN d USING (k) GROUP BY k),
n AS (SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY k)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN h USING (k) LEFT JOIN n USING (k)
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS u(i) WHERE len(w) > 0
), sets AS (
  SELECT doc_id, md5(string_agg(array_to_string(g, ' '), chr(10) ORDER BY array_to_string(g, ' '))) AS key, count(*) AS n FROM s GROUP BY doc_id
), reps AS (
  SELECT key, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY key
), rs AS (
  SELECT s.doc_id, s.g FROM s JOIN reps ON rep = s.doc_id
), rare AS (
  SELECT rs.doc_id, rs.g FROM rs JOIN (SELECT g FROM rs GROUP BY g HAVING count(*) > 1) USING (g)
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN reps q ON q.rep = p.a JOIN reps r ON r.rep = p.b WHERE 5 * shared >= 4 * (q.n + r.n - shared)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, a AS root FROM ways UNION SELECT e.b, reach.root FROM reach JOIN ways e ON e.a = reach.node
), cls AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), deg AS (
  SELECT a AS node, count(*) AS n_links FROM ways GROUP BY a
)
SELECT d.doc_id, coalesce(cls.root, reps.rep, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN reps ON reps.key = sets.key LEFT JOIN cls ON cls.node = reps.rep LEFT JOIN deg ON deg.node = reps.rep
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), t AS (SELECT k, i, w[i:i + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS u(i)),
often AS (SELECT k, g FROM t GROUP BY k, g HAVING count(*) > 1),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT t.k, unnest([i, i + 1, i + 2]) AS p FROM t JOIN often ON often.k = t.k AND often.g = t.g) GROUP BY k),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')))::BIGINT AS n_lettered,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_shouted
  FROM d LEFT JOIN r USING (k)
), f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(2 * n_shouted > n_words AS BIGINT)
    + 16 * CAST(5 * n_lettered < 4 * n_words AS BIGINT) + 32 * CAST(word_chars < 2 * n_words AS BIGINT) + 64 * CAST(word_chars > 20 * n_words AS BIGINT) + 128 * CAST(2 * n_dup_lines > n_lines AS BIGINT) AS failed FROM m
)
SELECT *, failed & 3 <> 0 AS base_failed, failed & 255 = 0 AS kept, 'prose-2' AS policy FROM f
"""

# The checksum is computed for distinct words only, with a table of 256 values from a recursion.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT v, 0 AS k, v::BIGINT AS c FROM range(256) t(v)
  UNION ALL SELECT v, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT no, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || hex(w)[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), q AS (SELECT no, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY no),
x AS (
  SELECT no, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN q USING (no)
), r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, 10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS wanted FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM r
"""

ORACLES = {"op11_fill_in_middle": OP11, "op12_quality_rules": OP12, "op13_importance_resampling": OP13, "op3_substring_dedup": OP3, "op8_jaccard_join": OP8, "op4_chat_roundtrip": OP4, "op6_decontamination": OP6, "op7_warc_archive": OP7}
