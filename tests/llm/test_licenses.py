"""License scans against brute force over every block; odd rows, long texts, names that clash."""

import re
import time

import numpy as np
import pytest

from marginalia.llm import licenses
from marginalia.llm.licenses import BASE, MORE, Template


def _brute(text, templates):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for n, t in enumerate(templates):
        own = licenses.template_words(t.text)
        if t.phrase:
            out += [(t.label, n, k, k + len(own), 1.0) for k in range(len(ws) - len(own) + 1) if ws[k : k + len(own)] == own]
            continue
        stride = -(-5 * len(own) // 4)
        for at in range(0, len(ws), stride):
            block = ws[at : at + 2 * stride]
            share = len(set(own) & set(block)) / len(set(own))
            if share >= 0.8 - 1e-12:
                there = [k for k, w in enumerate(block) if w in set(own)]
                out.append((t.label, n, at + there[0], at + there[-1] + 1, share))
    return len(ws), sorted(out)


def _cases():
    rng = np.random.default_rng(5)
    filler = ["wort", "the", "of", "and", "license", "be", "öd", "x1", "by", "cc"]
    out = ["Released under the MIT License.", "CC BY-NC, cc-by CC\nby; ccby", "gnu General PUBLIC License license", "MIT MIT license license mit\x00license", "Gnu general public licenſe", "apachelicense apache", "cc0 and creative commons attribution"]
    for t in MORE:
        ws = t.text.split()
        for drop in (0.0, 0.1, 0.19, 0.21, 0.3):
            own = [w for w in ws if rng.random() >= drop]
            more = list(own)
            for _ in range(len(own) // 8):
                more.insert(int(rng.integers(len(more) + 1)), filler[int(rng.integers(10))])
            pad = [filler[int(k)] for k in rng.integers(10, size=int(rng.integers(300)))]
            out += [" ".join(own), " ".join([*pad, *more, *pad[:50]]), " ".join(rng.permutation(own).tolist())]
    return out


@pytest.mark.parametrize("templates", [BASE + MORE, MORE[9:12], (Template("a", "by the by the by", True), Template("b", "license of the license"), Template("none", "?!"))])
def test_matches_are_those_of_every_block(spark, templates):
    rows = list(enumerate(_cases()))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()
    got = {r["doc_id"]: (r["n_words"], sorted(map(tuple, r["matches"]))) for r in found}
    own = [t for t in templates if licenses.template_words(t.text)]
    assert got == {k: _brute(t, own) for k, t in rows}
    assert any(m for _, m in got.values())


def test_each_filter_is_exact_and_bites(spark):
    """The prefix of a notice holds its rarest words alone, as counted over all documents."""
    order, sides = licenses.sides(BASE + MORE, {"the": 900, "license": 80, "gnu": 3, "public": 5, "general": 4})
    gpl = sides[0]
    assert gpl.ordered == ["gnu", "general", "public", "license"] and gpl.prefix == ["gnu"]
    for s in sides:
        assert len(s.prefix) == len(s.ordered) - s.need + 1 and s.ordered == [w for w in order if w in set(s.ordered)]
    docs = spark.createDataFrame([(k, "the license of the gnu" if k % 2 else "the") for k in range(10)], "doc_id long, text string")
    body = docs.select(licenses.words(docs["text"]).alias("w"))
    assert licenses.frequencies(body, ["the", "license", "gnu", "never"], "w") == {"the": 10, "license": 5, "gnu": 5}


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 7, 8), (None, "", 7, 8), (2, "mit license", 7, 8), (2, "mit license", 7, 8), (None, " \n", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, n_words int")
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "tokens", "n_words", "matches"]
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["tokens"], r["n_words"], len(r["matches"])) for r in out.collect()))
    assert got == [(0, "", 7, 0, 0), (0, " \n", 7, 0, 0), (1, "", 7, 0, 0), (2, "mit license", 7, 2, 1), (2, "mit license", 7, 2, 1)]
    empty = licenses.scan(docs.limit(0), templates=())
    assert empty.count() == 0 and empty.columns == out.columns
    assert licenses.scan(docs.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    text = "cc by " * 150_000 + MORE[12].text * 300
    start = time.perf_counter()
    [row] = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(m["template"] == 2 for m in row["matches"]) == 150_000
    assert sum(m["template"] >= 4 for m in row["matches"]) >= 200  # blocks, at a stride of one and a quarter copies
    assert time.perf_counter() - start < 90


def test_the_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(1)
    plan = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Window" not in plan
