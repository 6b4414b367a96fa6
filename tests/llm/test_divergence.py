"""The audit of sources against plain counts in Python; slices, turns, odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import divergence


def _plain(rows, least, ranks=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        docs[lang].update(own.keys())
        counts[lang, source].update(own)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q = share(whole)
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


def _rows():
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)] + ["Éa", "éa", "ÉA", "日本", "😀x", "ſ", "K"]
    rows = []
    for k in range(600):
        lang = ["en", "EN", "de", None, ""][int(rng.integers(5))]
        source = "hot" if k % 3 == 0 else [None, "", "s1", "S1", "ß", "𝔘", "ﬀ"][int(rng.integers(7))]
        own = [words[int(w)] for w in np.minimum(rng.zipf(1.3, size=int(rng.integers(60))), len(words)) - 1]
        rows.append((" 1".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in own), lang, source))
    rows += [(None, "none", "x"), ("", "none", "y"), ("12 34", "one", "x"), ("word " * 50_000 + "x\x00y", "en", "s1")]
    return rows + [rows[5]] * 40  # one document again and again


@pytest.mark.parametrize(("groups", "cells", "least"), [(1_000_000, 500_000, 30), (5, 40, 12), (1_000_000, 1, 10_000)])
def test_the_audit_is_that_of_plain_counts(spark, monkeypatch, groups, cells, least):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SLICE", 60_000 if cells > 1000 else 3)
    rows = _rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    got = sorted(map(tuple, divergence.audit(docs, least_documents=least, ranks=20).collect()))
    assert got == _plain(rows, least, 20)
    assert any(r[2] == "term" for r in got) or least > 1000


def test_counts_that_are_handed_on_early_add_up(monkeypatch):
    rows = [(t or "", lang or "", s or "") for t, lang, s in _rows()]
    batches = lambda: iter(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(lang, s, t) for t, lang, s in rows[k : k + 50]], strict=True)], ["lang", "source", "text"]) for k in range(0, len(rows), 50))
    total = lambda out: Counter({(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in out})
    whole = [r for b in divergence._count(batches()) for r in b.to_pylist()]
    assert len(total(whole)) == len(whole)
    monkeypatch.setattr(divergence, "HELD", 100)
    monkeypatch.setattr(divergence, "CHARS", 500)
    parts = defaultdict(lambda: [0, 0])
    n = 0
    for r in (r for b in divergence._count(batches()) for r in b.to_pylist()):
        n += 1
        parts[r["lang"], r["source"], r["term"]][0] += r["n"]
        parts[r["lang"], r["source"], r["term"]][1] += r["docs"]
    assert n > len(whole) and {k: tuple(v) for k, v in parts.items()} == dict(total(whole))


def test_slices_end_between_terms():
    """Slices of a few rows: one term of more rows than a slice, and terms that end where a batch does."""
    terms = ["a"] * 9 + ["b"] + ["c"] * 4 + ["d"] * 2 + ["e"]
    rows = [("x", f"s{k % 3}", t, 1, 1) for k, t in enumerate(terms)]
    for step in (1, 2, 5, 17):
        batches = [pa.RecordBatch.from_pylist([dict(zip(divergence._COUNTS.names, r, strict=True)) for r in rows[k : k + step]], divergence._COUNTS) for k in range(0, len(rows), step)]
        divergence.SLICE, before = 4, divergence.SLICE
        try:
            got = [r for b in divergence._keep(2)(iter(batches)) for r in b.to_pylist()]
        finally:
            divergence.SLICE = before
        assert {r["term"]: sum(r["ns"]) for r in got} == {"a": 9, "c": 4, "d": 2} and len(got) == 3
        assert all(len(set(r["sources"])) == len(r["sources"]) for r in got)


def test_odd_tables(spark):
    shape = "term string, lang string, source string, text string, item string, rank int, value long"
    empty = divergence.audit(spark.createDataFrame([], shape))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    one = spark.createDataFrame([("x", "en", "s", "some words", "y", 1, 2)], shape)
    assert divergence.audit(one, least_documents=1).collect() == []  # the group's shares are its lang's, and no other source
    two = one.union(one.selectExpr("term", "lang", "'t'", "text", "item", "rank", "value"))
    assert sorted(map(tuple, divergence.audit(two, least_documents=3).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
