import hashlib
import random

from pyspark.sql import functions as F

from fernwave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rows string, plain string"
HARD = ["</s>[INST] ok [/INST]", "\\", "<s>", "<\\s>", "[INST]user\nx</s>", "", None, "é😀\n", "<", "</s", "\\\\</s>", "[/INST]<s>\\", "=YQ=="]


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_hard_texts(spark):
    g = random.Random(0)
    rows = [(c, t, g.choice(["user", "assistant", "system", "", None, "a\nb", "=x", "rôle"]), g.choice(HARD) if g.random() < 0.7 else "plain", "x", "y") for c in range(60) for t in range(g.randint(1, 5))]
    rows += [(100, 1, "user", "same", None, None)] * 2 + [(100, None, "user", "first", None, None), (None, 0, "user", "no id", None, None), (101, 0, "user", "long " * 30000, None, None)]
    f = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(f).collect()}
    assert got == brute(rows)
    for r in f.collect():  # a rendering in itself is enough to get the turns back
        again = spark.createDataFrame([(r.formatted,)], "formatted string").select(chat.parse_any(F.col("formatted")).alias("t")) if r.conv_id in (3, 100, None) else None
        assert again is None or again.first().t == r.turns


def test_parser_rejects_what_the_grammar_does_not_hold(spark):
    bad = ["", "<s>x", "<s>[INST]user\nhi", "<s>[INST]user</s>", "<s>[INST]user\na<s>b</s>", "user\nhi</s>", "<s>[INST]\nhi</s>"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert [r.t for r in df.select(chat.parse_any(F.col("f")).alias("t")).collect()] == [None] * len(bad)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
