import pytest
import regex

from fernwave.llm import pii

from .test_pii import brute, luhn


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(200):
        rows.append((i, f"mail user{i}@host{i % 7}.com or call +44 20 7946 {i:04d} today, look (at) this{i} and 3 @ home"))
        rows.append((1000 + i, f"we sold {i:05d} 1{i:05d} 77 pieces in 20{i % 100:02d}-10-{i % 30:02d} 12.30"))
    for i in range(200):
        rows.append((2000 + i, f"from host 10.{i % 256}.7.{i} and version 1.{i:03d}.400.900 at once"))
    rows.append((5000, "call 020 7946 0958 or mail bob (at) mail (dot) com now"))
    rows.append((5002, "reach host 10[.]20[.]30[.]40 or 999[.]20[.]30[.]40 there"))
    rows.append((5001, "we sold 12345 67890 11 and look (at) that"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spans_that_no_base_rule_matches_are_added(docs):
    got = {r.doc_id: r for r in pii.digest(docs).filter("doc_id >= 5000").collect()}
    assert [got[5000][f"n_{k}"] for k in pii.KINDS] == [0, 0, 0, 0]
    assert got[5000].spans == "email:27:50,phone:5:18"
    assert got[5001].spans == ""
    assert got[5002].spans == "ip:11:28"


def test_added_spans_are_redacted(docs):
    got = {r.doc_id: r.text for r in pii.redact(docs).filter("doc_id >= 5000").collect()}
    assert got == {5000: "call [PHONE] or mail [EMAIL] now", 5002: "reach host [IP] or 999[.]20[.]30[.]40 there", 5001: "we sold 12345 67890 11 and look (at) that"}


def test_too_many_combinations_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(pii, "MOST_COMBINATIONS", 2)
    with pytest.raises(ValueError, match="combinations"):
        pii.fit(pii.found(docs))


def described(t, before, after):
    """The features of a candidate, by brute force."""
    import re

    n = re.sub("[^0-9]", "", t)
    whole = lambda p: regex.fullmatch(p, t) is not None
    plain = re.sub(r" ?(?:\.|\[\.\]|\(dot\)|\[dot\]) ?", ".", t)
    kind = 0 if re.search(r"@|\(at\)|\[at\]", t) else 1 if whole(pii.CANDIDATE["ip"]) else 2 if len(n) >= 13 and not t.startswith("+") and not (t.startswith("00") and len(n) <= 15) else 3
    return [
        kind, min(20, len(n)), min(15, len(t) // 4), t.startswith("+"), 13 <= len(n) <= 19 and luhn(n), min(5, t.count(".")), min(8, sum(c in " ()-" for c in t)),
        re.search(r"[A-Za-z0-9_]\Z", before) is not None, re.match(r"[A-Za-z0-9_]", after) is not None, kind == 1 and all(int(p) <= 255 for p in plain.split(".")),
        re.search(pii.CONTEXT.replace(r"\z", r"\Z"), before, re.A) is not None, min(2, t.count("@")), re.search(r"(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,12}\Z", t) is not None,
    ]


def test_all_spans_match_brute_force(docs):
    """Candidates by Python's regular expressions, features and scores in numpy, from the fitted trees."""
    import numpy as np

    trees, threshold = pii.fit(pii.found(docs))
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    n_added = 0
    for r in docs.collect():
        base = [(k, a, z) for k, v in brute(r.text).items() for a, z in v]
        every = list(base)
        for name, p in pii.CANDIDATE.items():
            for m in regex.finditer(p, r.text):
                if name == "email" and not any(x in r.text for x in ("@", "(at)", "[at]")):
                    continue
                if any(a < m.end() and z > m.start() for _, a, z in base):
                    continue
                f = described(m.group(), r.text[max(0, m.start() - 24) : m.start()], r.text[m.end() : m.end() + 1])
                if pii.scores(trees, np.array([f], dtype=np.int64))[0] >= threshold:
                    every.append((pii.KINDS[f[0]], m.start(), m.end()))
                    n_added += 1
        want = ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(set(every), key=lambda s: (pii.KINDS.index(s[0]), *s[1:])))
        assert got[r.doc_id] == want, r.text
    assert n_added >= 3


def test_national_numbers_where_no_base_number_has_a_hint_before_it(spark):
    """Numbers with '+' in plain prose only: a number without it is taken after a word that speaks of telephones, and left alone elsewhere."""
    rows = [(i, f"the house at +{1 + i % 49} (0{i % 10}7) 555-{1000 + i} was sold and {i:016d} things x{i}@y.org were {i:08d}ab") for i in range(300)]
    planted = {"call ": ["030 1234567 89", "0049 30 1234567", "(030) 123-456-789"], "tel: ": ["0049 30 1234567", "020 7946 0958"], "Phone ": ["017 555 7713"]}
    probes = [(w, n) for w, ns in planted.items() for n in ns]
    plain = ["we sold 12345 67890 11 pieces", "born 2020-10-12 12.30 there", "the 020 7946 0958 houses", "call 12 34 now", "call 1234567890123456 now"]
    texts = [f"{w}{n} now" for w, n in probes] + plain
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id - 1000: r for r in pii.digest(docs).filter("doc_id >= 1000").collect()}
    for i, (w, n) in enumerate(probes):
        assert got[i].spans == f"phone:{len(w)}:{len(w) + len(n)}" and got[i].n_phone == 0, texts[i]
    assert [got[len(probes) + i].spans for i in range(len(plain))] == [""] * len(plain)
