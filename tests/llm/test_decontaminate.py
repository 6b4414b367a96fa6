"""Benchmark items in documents against brute overlap of grams, whole and in parts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, queries

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"\w+")


def _brute(docs, items):
    """(doc, item) to the shares of question grams and answer words, of all pairs that verification takes."""
    grams = lambda w, g: [tuple(w[k : k + g]) for k in range(len(w) - g + 1)]
    out, cache = {}, {}
    for i, text in items:
        words = WORD.findall((text or "").lower())
        if not words:
            continue
        g = min(5, len(words))
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if WORD.search(s)]
        q = len(words) - len(WORD.findall(sentences[-1].lower())) if len(sentences) > 1 else 0
        own = grams(words, g)
        for d, t in docs:
            if (d, g) not in cache:
                cache[d, g] = set(grams(WORD.findall((t or "").lower()), g))
            there = [x in cache[d, g] for x in own]
            if not any(there):
                continue
            covered = [any(there[max(0, k - g + 1) : k + 1]) for k in range(len(words))]
            asked = there[: max(1, q - g + 1)] if q >= g else there
            shares = sum(asked) / len(asked), sum(covered[q:]) / len(covered[q:])
            if shares[0] >= 0.8 and shares[1] >= 0.5:
                out[d, i] = shares
    return out


def _rows(found):
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_the_query_finds_what_brute_overlap_finds(spark):
    docs, items = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "benchmark")
    want = _brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = _rows(queries.op8_decontaminate(spark, DATA))
    assert want and got.keys() == want.keys()
    assert all((got[k]["question_overlap"], got[k]["answer_overlap"]) == pytest.approx(want[k]) for k in want)


def _planted():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(3000, size=n))
    items = [(k, f"{text(int(rng.integers(12, 70)))}? {text(int(rng.integers(4, 30)))}.") for k in range(60)]
    docs = []
    for k, (_, item) in enumerate(items):
        question, answer = item.split("? ")
        q, a = question.split(" "), answer.rstrip(".").split(" ")
        lost = int(0.2 * max(1, len(q) - 4))
        docs += [
            (10 * k, f"{text(100)} {question} {text(90)} {answer} {text(50)}"),  # far apart
            (10 * k + 1, f"{text(30)} {' '.join(q[lost:])} {text(300)} {' '.join(a[: max(3, (len(a) + 5) // 2)])} {text(5)}"),  # in parts
            (10 * k + 2, f"{text(70)} {' '.join(q[: len(q) - lost])} {text(7)} {answer}"),
            (10 * k + 3, f"{text(60)} {question} {text(60)}"),  # no answer
            (10 * k + 4, text(400)),
        ]
    return docs, items


@pytest.mark.parametrize("chars", [1 << 20, 3000])
def test_items_in_parts_are_found_with_the_same_scores_in_any_number_of_indexes(spark, monkeypatch, chars):
    docs, items = _planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    whole = _rows(decontaminate.find(d, b))
    assert whole.keys() == want.keys() and len(want) > 120
    monkeypatch.setattr(decontaminate, "CHARS_IN_INDEX", chars)
    assert _rows(decontaminate.find(d, b)) == whole
    kept = decontaminate.clean(d.withColumn("item_id", F.lit("x")), b)
    assert kept.columns == ["doc_id", "text", "item_id"] and {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_scores_are_those_of_bm25(spark):
    docs, items = _planted()
    words = [WORD.findall(t.lower()) for _, t in items]
    mean, df = sum(map(len, words)) / len(words), Counter(w for own in words for w in set(own))
    text = dict(docs)
    for (doc, item), r in list(_rows(decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))).items())[:30]:
        own, said = Counter(words[item]), WORD.findall(text[doc].lower())
        impact = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[item]) / mean)) for w, n in own.items()}
        assert r["score"] == pytest.approx(max(sum(impact.get(w, 0) for w in set(said[s : s + 64])) for s in range(0, len(said), 32)))


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (4, "so one TWO, three"), (4, "so one TWO, three"), (None, "three four five six seven eight " + "x " * 100_000)], "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("score", F.lit("s"))
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in decontaminate.find(docs, bench).collect()))
    assert got == [(0, 0), (4, 3), (4, 3), (4, 3), (4, 3)]
    assert decontaminate.find(docs.where("false"), bench).count() == 0 == decontaminate.find(docs, bench.where("false")).count()
