"""Personal data: base patterns, high-recall candidates, and boosted trees that choose among the latter.

DataFrame functions only. The base patterns of four kinds (KINDS) are exact rules; their spans always stay. Wider
patterns propose candidate spans, which may overlap: mail addresses with spaced or spelt-out signs, four numbers between
dots of such kinds, and runs of digits and separators. Trees
score each candidate by its format and context. They are fitted by gradient boosting to candidates that touch no base
span, as only those can be added. The positives are sound base spans rewritten, in their own context, so that no base
rule matches them any more (REWRITTEN: signs spelt out or spaced, '+' written 00 or gone, country code gone, card groups
set apart). A number without '+' could be any number: each is taken twice, in its own context and after a word that speaks
of telephones (HINT), and is a positive where such a word stands before it, else a negative. The other
negatives are the documents' own candidates, less those for which format and context both speak (`telling`), which are
neither. Counts of each combination of features (at most MOST_COMBINATIONS, checked) are all that the driver sees. A
threshold is calibrated on the documents kept out of the fit: halfway between the least score selected and the greatest
one below, where at least PRECISION of what is selected is right by these labels. Trees become CASE expressions. A
candidate that is selected and overlaps no base span is added.

Spans are (kind, start, end) in code points, end exclusive. A null text is an empty one. Texts without '@', '(at)',
'[at]' or a digit are passed over at once. The patterns are written so that their cost is linear in the text and their
depth bounded, also for one endless run of letters or digits. Repeated rows get equal results; rows are never joined or
grouped. Columns other than doc_id and text are not read; an empty table gives an empty result, and a corpus without
candidates of both classes gives base spans only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, PRECISION = 40, 0.3, 0.99
MOST_COMBINATIONS = 200_000
SPAN = "struct<start:int,end:int,text:string>"

_L, _X, _DOT = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]", r"(?:\.|\[\.\]|\(dot\)|\[dot\])"
#: The contract's patterns, written with possessive and lazy loops over single characters in place of loops over
#: groups; what they match is the same. \G lets a match begin where the last one ended.
BASE = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@{_X}++\.(?={_X})[A-Za-z0-9.-]*?(?=\.(?!{_X})|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-](?![0-9])|[^0-9\x20-]|\z)",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = {
    # A domain name has at most 127 labels.
    "email": rf"(?:(?<!{_L})|\G){_L}++[\x20]?(?:@|\(at\)|\[at\])[\x20]?{_X}++(?:[\x20]?{_DOT}[\x20]?{_X}++){{0,126}}",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:[\x20]?{_DOT}[\x20]?[0-9]{{1,3}}+){{3}}(?![0-9])",
    "number": r"(?:\((?=[0-9]{1,5}\)))?\+?[0-9][0-9\x20().-]{5,}[0-9]",
}
CONTEXT = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|account|ip|host|addr)[a-z]*\W{0,3}\z"
#: For each kind, what becomes of a sound base span: regular expressions with their replacements, applied in order.
REWRITTEN = {
    "email": [[("@", " (at) "), (r"\.(?=[^.]*\z)", " (dot) ")], [("@", "[at]"), (r"\.(?=[^.]*\z)", "[dot]")], [("@", " @ ")], [("@", " (at) ")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", " . ")], [(r"\.", "(dot)")]],
    "card": [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1  ")]],
    "phone": [[(r"^\+", "")], [(r"^\+", "00")], [(r"^\+[0-9]{1,3}[\x20.-]", "0")], [(r"^\+[0-9]{1,3}[\x20.-]", "")]],
}
#: Matches CONTEXT at its end.
HINT = "tel: "
FEATURES = ("kind", "digits", "length", "plus", "luhn", "dots", "marks", "before", "after", "octets", "context", "at", "domain")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches, left to right, places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        a = acc["at"] + F.char_length(F.get(between, i))
        z = a + F.char_length(m)
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), z.alias("end"), m.alias("text")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits (at most 19) passes Luhn's check."""
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def octets(text: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(text, r"\.", -1), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def dotted(text: Column) -> Column:
    """An address of numbers with plain dots."""
    return F.regexp_replace(text, rf"[\x20]?{_DOT}[\x20]?", ".")


def sound(kind: str, text: Column) -> Column:
    n = F.length(digits(text))
    if kind == "ip":
        return octets(dotted(text))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(sign, F.filter(matches(text, BASE[kind]), lambda m: sound(kind, m["text"]))).otherwise(none)


def candidates(text: Column) -> Column:
    """array<struct<start, end, text>> of all that might be personal data, overlapping where the patterns do."""
    none = F.array().cast(f"array<{SPAN}>")
    signed = F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    address = F.when(signed, matches(text, CANDIDATE["email"])).otherwise(none)
    digit = text.rlike("[0-9]")
    number = F.when(digit, matches(text, CANDIDATE["number"])).otherwise(none)
    parts = F.when(digit & text.rlike(rf"[0-9][\x20]?{_DOT}[\x20]?[0-9]"), matches(text, CANDIDATE["ip"])).otherwise(none)
    return F.concat(address, parts, number)


def kind_of(text: Column) -> Column:
    """Number of the kind that a candidate's format suggests."""
    n = F.length(digits(text))
    return (
        F.when(text.rlike(r"@|\(at\)|\[at\]"), 0)
        .when(text.rlike(rf"^{CANDIDATE['ip']}\z"), 1)
        .when((n >= 13) & ~text.startswith("+") & ~(text.startswith("00") & (n <= 15)), 2)
        .otherwise(3)
    )


def around(text: Column, c: Column) -> tuple[Column, Column]:
    """Up to 24 characters before c and one after it."""
    return F.substring(text, F.greatest(F.lit(1), c["start"] - 23), F.least(c["start"], F.lit(24))), F.substring(text, c["end"] + 1, F.lit(1))


def features(text: Column, c: Column) -> Column:
    """struct of FEATURES of candidate c within its text."""
    return described(c["text"], *around(text, c))


def described(t: Column, before: Column, after: Column) -> Column:
    """struct of FEATURES, small whole numbers, of a candidate t between what stands before and after it."""
    number = digits(t)
    n = F.length(number)
    count = lambda chars, most: F.least(F.lit(most), F.length(F.regexp_replace(t, f"[^{chars}]", "")))
    values = [
        kind_of(t),
        F.least(F.lit(20), n),
        F.least(F.lit(15), F.floor(F.length(t) / 4)),
        t.startswith("+"),
        F.when((n >= 13) & (n <= 19), luhn(number)).otherwise(F.lit(False)),
        count(".", 5),
        count(r"\x20()\-", 8),
        before.rlike(r"\w\z"),
        after.rlike(r"\w"),
        F.when(kind_of(t) == 1, octets(dotted(t))).otherwise(F.lit(False)),
        before.rlike(CONTEXT),
        count("@", 2),
        t.rlike(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,12}\z"),
    ]
    return F.struct(*[v.cast("int").alias(f) for v, f in zip(values, FEATURES, strict=True)])


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base: an array of spans for each kind, candidates with their features and whether they touch a base span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS]).alias("base"), candidates(F.col("text")).alias("c"))
    touches = lambda c, s: (s["start"] < c["end"]) & (s["end"] > c["start"])

    def seen(c: Column) -> Column:
        of = [F.exists(F.col("base")[k], lambda s: touches(c, s)) for k in KINDS]
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), features(F.col("text"), c).alias("f"), (of[0] | of[1] | of[2] | of[3]).alias("taken"))

    return d.select("doc_id", "text", "base", F.transform("c", seen).alias("candidates"))


def rewritten(text: Column, base: Column) -> Column:
    """array<struct<f struct of FEATURES, known>>: base spans rewritten as REWRITTEN says, where a candidate is that whole and
    no base rule matches it."""

    def changed(way: list, hint: bool = False) -> Callable[[Column], Column]:
        def one(c: Column) -> Column:
            t = c["text"]
            for pattern, new in way:
                t = F.regexp_replace(t, pattern, new)
            before, after = around(text, c)
            before = F.lit(HINT) if hint else before
            return F.struct(t.alias("t"), before.alias("before"), after.alias("after"))

        return one

    def good(kind: str) -> Callable[[Column], Column]:
        def whole(r: Column) -> Column:
            fits = r["t"].rlike(rf"^(?:{CANDIDATE.get(kind, CANDIDATE['number'])})\z") & sound(kind, r["t"]) & (kind_of(r["t"]) == KINDS.index(kind))
            for k in KINDS:
                fits = fits & (F.size(base_spans(r["t"], k)) == 0)
            return fits

        return whole

    out = [F.filter(F.transform(base[kind], changed(way)), good(kind)) for kind, ways in REWRITTEN.items() for way in ways]
    out += [F.filter(F.transform(base["phone"], changed(way, hint=True)), good("phone")) for way in REWRITTEN["phone"]]

    def labelled(r: Column) -> Column:
        f = described(r["t"], r["before"], r["after"])
        return F.struct(f.alias("f"), F.when(f["kind"] == KINDS.index("phone"), f["context"]).otherwise(1).alias("known"))

    return F.transform(F.concat(*out), labelled)


def telling(f: Column) -> Column:
    """Whether a candidate that no base rule matches may well be personal data: it is no negative."""
    address = (f["kind"] == 0) & (f["domain"] == 1)
    numbers = (f["kind"] == 1) & (f["octets"] == 1)
    card = (f["kind"] == 2) & (f["luhn"] == 1)
    phone = (f["kind"] == 3) & f["digits"].between(9, 15) & (f["context"] == 1)
    return address | numbers | card | phone


@dataclass
class Tree:
    """Splits x[a] >= s, then x[b] >= t on either side; `leaf` holds the four values."""

    a: int
    s: int
    sides: list[tuple[int, int]]
    leaf: list[float]


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    best, (gs, hs) = (0.0, 0, int(x[:, 0].max(initial=0)) + 1), (g.sum(), h.sum())
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[1:]:
            up = x[:, j] >= t
            gu, hu = g[up].sum(), h[up].sum()
            gain = gu**2 / (hu + 1) + (gs - gu) ** 2 / (hs - hu + 1) - gs**2 / (hs + 1)
            if gain > best[0] + 1e-9:
                best = (gain, j, int(t))
    return best


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> list[Tree]:
    """Gradient boosting of logistic loss with trees of depth two, on weighted combinations of features."""
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        _, a, s = _best_split(x, g, h)
        up, sides, leaf = x[:, a] >= s, [], []
        for side in (~up, up):
            _, b, t = _best_split(x[side], g[side], h[side])
            sides.append((b, t))
            for part in (side & (x[:, b] < t), side & (x[:, b] >= t)):
                v = RATE * g[part].sum() / (h[part].sum() + 1)
                leaf.append(round(float(v), 6))
                score[part] += leaf[-1]
        trees.append(Tree(a, s, sides, leaf))
    return trees


def scores(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        up = x[:, t.a] >= t.s
        low, high = x[:, t.sides[0][0]] >= t.sides[0][1], x[:, t.sides[1][0]] >= t.sides[1][1]
        out += np.where(up, np.where(high, t.leaf[3], t.leaf[2]), np.where(low, t.leaf[1], t.leaf[0]))
    return out


def score_column(trees: list[Tree], f: Column) -> Column:
    out = F.lit(0.0)
    for t in trees:
        at = lambda side: f[FEATURES[side[0]]] >= side[1]
        low = F.when(at(t.sides[0]), t.leaf[1]).otherwise(t.leaf[0])
        high = F.when(at(t.sides[1]), t.leaf[3]).otherwise(t.leaf[2])
        out = out + F.when(f[FEATURES[t.a]] >= t.s, high).otherwise(low)
    return out


def fit(seen: DataFrame) -> tuple[list[Tree], float] | None:
    """Trees and threshold, from all documents' candidates and rewritten base spans; None where there are not both classes."""
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("out")
    bad = F.transform(F.filter("candidates", lambda c: ~c["taken"] & ~telling(c["f"])), lambda c: F.struct(c["f"].alias("f"), F.lit(0).alias("known")))
    one = seen.select(fold, F.explode(F.concat(bad, rewritten(F.col("text"), F.col("base")))).alias("c")).select("out", "c.f.*", "c.known")
    rows = one.groupBy("out", *FEATURES, "known").agg(F.count(F.lit(1)).alias("n")).limit(MOST_COMBINATIONS + 1).toPandas()
    if len(rows) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of features")
    rows = rows.sort_values(["out", *FEATURES, "known"], kind="stable")
    fitted, kept = rows[~rows["out"]], rows[rows["out"]]
    if fitted["known"].nunique() < 2:
        return None
    values = lambda r: (r[list(FEATURES)].to_numpy(dtype=np.int64), r["known"].to_numpy(dtype=float), r["n"].to_numpy(dtype=float))
    trees = boost(*values(fitted))
    x, y, n = values(kept if len(kept) else fitted)
    s = scores(trees, x)
    order = np.argsort(-s, kind="stable")
    right = np.cumsum((y * n)[order]) / np.cumsum(n[order])
    ends = np.append(np.diff(s[order]) != 0, True)
    good = np.flatnonzero(ends & (right >= PRECISION) & (s[order] > 0))
    if not len(good):
        return None
    last = good[-1]
    below = s[order][last + 1] if last + 1 < len(s) else 0.0
    return trees, max(1e-6, float(s[order][last] + below) / 2)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added): base spans by kind; chosen candidates as (kind number, start, end)."""
    seen = found(docs)
    model = fit(seen)
    chosen = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if model is not None:
        trees, threshold = model
        good = F.filter("candidates", lambda c: ~c["taken"] & (score_column(trees, c["f"]) >= threshold))
        chosen = F.transform(good, lambda c: F.struct(c["f"]["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return seen.select("doc_id", "text", "base", chosen.alias("added"))


def base_list(base: Column) -> Column:
    """Base spans as (kind number, start, end), in the order of kinds, then starts."""

    def of(i: int, k: str) -> Column:
        return F.transform(base[k], lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    d = detect(docs)
    base = base_list(F.col("base"))
    return d.select(
        "doc_id",
        *[F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.array_sort(F.array_distinct(F.concat(base, F.col("added"))))).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, more).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(1 << 30)))
    return F.when(F.size(spans) > 0, F.aggregate(by_place, start, step, done)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans replaced in `text`, and `n_chars` (if there is one) counted anew; null texts stay null.

    One pass over the rows: the spans are found beside the other columns, so nothing is joined.
    """
    model = fit(found(docs.select("doc_id", "text")))
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = docs.select(inner)
    named = kept.select("_row", F.col("_row.doc_id").alias("doc_id"), F.coalesce("_row.text", F.lit("")).alias("text"))
    return named.transform(lambda d: _redact_rows(d, model, docs.columns))


def _redact_rows(rows: DataFrame, model: tuple[list[Tree], float] | None, columns: list[str]) -> DataFrame:
    spans = base_list(F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS]))
    seen = rows.select("_row", "text", spans.alias("spans"), candidates(F.col("text")).alias("c"))
    if model is not None:
        trees, threshold = model
        free = lambda c: ~F.exists("spans", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        # Features stand in a column of their own: the trees name each of them many times.
        wide = F.transform(F.filter("c", free), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(F.col("text"), c).alias("f")))
        seen = seen.select("_row", "text", "spans", wide.alias("c"))
        good = F.filter("c", lambda c: score_column(trees, c["f"]) >= threshold)
        more = F.transform(good, lambda c: F.struct(c["f"]["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        seen = seen.select("_row", "text", F.concat("spans", more).alias("spans"))
    clean = seen.select("_row", redacted(F.col("text"), F.col("spans")).alias("_clean"))
    text = F.when(F.col("_row.text").isNotNull(), F.col("_clean"))
    out = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return clean.select(*[out.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
