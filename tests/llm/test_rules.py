"""The quality ledger against measurements by plain Python, and ablations against a policy without the rule."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fernwave.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(windows) if windows.count(g) > 1 for p in (i, i + 1, i + 2)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    lettered = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    shouted = sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(lines), lettered, shouted


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbé漢😀 \t\n\n  \r\x0b\x0c\x00\x1c\x85\xa0#*|<7", max_size=80))
def test_measures(text):
    assert rules.measure(text.encode()) == expected(text)


def test_repeats_of_many_words():
    words = [b"w%d" % (k % 5000) for k in range(9000)]
    assert rules.repeated_words(words) == 2 * 4000  # the first 4000 come twice; no window straddles
    assert rules.repeated_words([b"a"] * 4) == 4
    assert rules.repeated_words([b"a", b"b", b"c"]) == 0


PROSE = " ".join(f"word{k} goes" for k in range(40))
TEXTS = [None, "", "one", PROSE, PROSE, PROSE.upper(), "a b c " * 40, " | ".join(PROSE.split()), "1 2 3 4 5 " + PROSE, " ".join(str(k) for k in range(60)), "\n".join(["the same line here"] * 3 + [f"{k} new line" for k in range(2)]) + PROSE, "é " * 3 + PROSE * 3000]


def docs(spark):
    rows = [(k, t, 7, True) for k, t in enumerate(TEXTS)] + [(None, PROSE, 7, True), (3, PROSE, 7, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean").repartition(3), rows  # names clash


def test_ledger_and_verdicts(spark):
    given_, rows = docs(spark)
    got = rules.verdicts(given_).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_lettered, r.n_shouted) for r in got) == sorted((str(i), *(e[:4] + e[5:])) for i, t, *_ in rows for e in [quick(t)])
    at = {r.doc_id: r for r in got if r.doc_id is not None}
    assert at[0].base_failed and at[1].base_failed and at[2].base_failed and not at[2].kept
    assert at[3].kept and at[4].kept and at[8].kept
    assert at[5].failed == rules.BITS["shouting"] and not at[5].base_failed and not at[5].kept
    assert at[6].base_failed and at[6].n_repeat_words == 120
    assert at[7].failed & rules.BITS["symbols"] and not at[7].kept
    assert at[9].failed & rules.BITS["unlettered"]
    assert at[11].base_failed


def quick(text):
    """As `expected`, but without the quadratic count of windows."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    lettered = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    shouted = sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None, len(lines), lettered, shouted


def test_policies_and_ablations(spark):
    ledger = rules.stored(docs(spark)[0])
    kept = {p: rules.apply_policy(ledger, p).filter("kept").count() for p in rules.POLICIES}
    assert kept["base-1"] > kept["prose-1"] > 0
    rows = {(r.policy, r.rule): r for r in rules.ablations(ledger).collect()}
    assert set(rows) == {(p, r) for p in rules.POLICIES for r in rules.POLICIES[p]}
    for (p, rule), r in rows.items():
        without = {p: [x for x in rules.POLICIES[p] if x != rule]}
        assert r.n_kept == kept[p]
        assert r.n_kept_without == rules.apply_policy(ledger, p, without).filter("kept").count()
        masks = [x.failed & rules.mask(p) for x in ledger.collect() if x.failed & rules.BITS[rule]]
        assert r.n_failed == len(masks)
        ever, always = 0, -1
        for m in masks:
            ever, always = ever | m & ~rules.BITS[rule], always & m & ~rules.BITS[rule]
        assert (r.ever_with, r.always_with) == (ever, always if masks else 0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rules.verdicts(empty).collect() == []
    assert rules.ablations(rules.ledger(empty)).collect() == []
