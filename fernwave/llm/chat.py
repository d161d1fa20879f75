"""Chat formatting with a grammar that reparses to the very turns it was rendered from. DataFrame functions only.

    conversation = "<s>" [ESCAPED] turn*        ESCAPED = "\\"
    turn         = "[INST]" role LF text "</s>"
    role         = [A-Za-z0-9_]+ | "=" base64

The parser cuts at "</s>", checks each turn's "[INST]" and role, and accepts no control string inside a text. Each
conversation is rendered plainly and reparsed; where the turns that come back differ from the source, the rendering is
made again with every text's backslashes doubled and its control strings broken by a backslash, and reparsed again. An
escaped rendering that did not come back identical would be an error, never a silently changed conversation.

Null texts and roles are empty strings; a null turn sorts first; turns that tie are ordered by role, then text, and
repeated rows are repeated turns. Other columns are not read. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, ESCAPE = "<s>", "[INST]", "</s>", "\\"
CONTROL = (BEGIN, CLOSE, OPEN, "[/INST]")
TURN = "struct<role:string,text:string>"


def escaped(text: Column) -> Column:
    """No control string is left in the result; `unescaped` restores the text exactly."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_out(role: Column) -> Column:
    return F.when(role.rlike(r"^[A-Za-z0-9_]+\z"), role).otherwise(F.concat(F.lit("="), F.replace(F.base64(F.encode(role, "utf-8")), F.lit("\r\n"), F.lit(""))))


def role_in(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unbase64(F.substring(role, 2, 1 << 30)), "utf-8")).otherwise(role)


def render(turns: Column, escape: bool) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), role_out(t["role"]), F.lit("\n"), escaped(t["text"]) if escape else t["text"], F.lit(CLOSE))
    return F.concat(F.lit(BEGIN + ESCAPE * escape), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column, escape: bool) -> Column:
    """The turns of a rendering, or null where it is not a sentence of the grammar."""
    head = BEGIN + ESCAPE * escape
    parts = F.split(F.substring(formatted, len(head) + 1, 1 << 30), F.lit(r"\Q" + CLOSE + r"\E"), -1)
    body = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        inner = F.substring(p, len(OPEN) + 1, 1 << 30)
        cut = F.instr(inner, "\n")
        text = F.substring(inner, cut + 1, F.lit(1 << 30))
        role = role_in(F.substring(inner, F.lit(1), cut - 1))
        bad = ~p.startswith(OPEN) | (cut < 2)
        for c in CONTROL:
            bad = bad | F.contains(text, F.lit(c))
        return F.when(~bad, F.struct(role.alias("role"), (unescaped(text) if escape else text).alias("text")))

    turns = F.transform(body, one)
    sound = formatted.startswith(head) & (F.element_at(parts, -1) == "") & F.forall(turns, lambda t: t.isNotNull())
    return F.when(sound, turns)


def parse_any(formatted: Column) -> Column:
    return F.when(formatted.startswith(BEGIN + ESCAPE), parse(formatted, True)).otherwise(parse(formatted, False))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): a rendering for each conversation, and the turns as its parser reads them back."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    source = grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), False))
    same = parse(F.col("plain"), False).eqNullSafe(F.col("source"))
    formatted = plain.select("conv_id", "source", F.when(same, F.col("plain")).otherwise(render(F.col("source"), True)).alias("formatted"))
    read = formatted.withColumn("turns", parse_any(F.col("formatted")))
    checked = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns"))
    failed = F.raise_error(F.concat(F.lit("no faithful rendering of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return read.select("conv_id", "formatted", F.coalesce(checked, failed.cast(f"array<{TURN}>")).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a rendering holds, read back from it: its turns, and the text under the loss mask (assistants' turns)."""
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(every, "utf-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "utf-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
