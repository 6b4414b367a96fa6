"""Line dedup against brute force; common lines, clashing columns and odd rows."""

import time

import pytest
from pyspark.sql import functions as F

from marginalia.llm import lines


def _brute_lines(rows):
    def near(a, b):
        a, b = a.split(" "), b.split(" ")
        if a == b:
            return True
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    seen, out = [], {}
    for d, text in sorted(rows):
        kept = []
        for x in text.split("\n"):
            y = x.strip(" ")
            if y and any(near(y, z) for z in seen):
                seen.append(y)
                continue
            if y:
                seen.append(y)
            kept.append(x)
        out[d] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rows = [(1, "a b c d e f\nx y\n\nshort"), (2, "a b c d e\nx z\nq b c d e f"), (3, "a a b c d e f\nx y\nA b c d e f g h"), (4, "a b c d e f g h\n x y \nshort"), (5, "b a c d e f g\nnew line of six words here")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_lines(rows)


@pytest.mark.parametrize("hot", [2, 100_000])
def test_a_line_of_half_of_all_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    rows = [(k, ("the very same line of words\n" if k % 2 else "") + f"own line number {k} of text here\n" + ("the very same line of word" if k % 3 else "z")) for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_lines(rows)


def test_columns_of_any_name_are_kept(spark):
    names = ["d", "own", "at", "new", "_gone", "_d", "_new", "k", "k2", "first", "line", "dealt", "a.b"]
    rows = [(1, "a b c d e\nx", *range(len(names)), 7), (2, "a b c d q\ny", *range(len(names)), 8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names, "n_lines"])
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    got = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[2:-2] for r in got] == [tuple(range(len(names)))] * 2
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in got] == [("a b c d e\nx", 2, 0), ("y", 2, 1)]


def test_odd_rows(spark):
    rows = [(1, "one\ntwo"), (None, "two\nthree"), (None, "two\nthree"), (None, "four\nthree"), (None, None), (2, None), (3, ""), (3, "two"), (3, "two"), (4, " \n\n")]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, "one\ntwo", 2, 0), (None, "three", 2, 1), (None, "three", 2, 1), (None, "four\nthree", 2, 0), (None, None, 0, 0), (2, None, 0, 0), (3, "", 1, 0), (3, "", 1, 1), (3, "", 1, 1), (4, " \n\n", 3, 0)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    empty = lines.dedup(spark.createDataFrame([], "doc_id long, text string, n_lines int"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_a_text_of_very_many_lines(spark):
    """Each line of the second text repeats one of the first: time in proportion to their number."""
    text = "\n".join(f"line {k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nlast"), (3, "word " * 100_000)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup(docs).select("doc_id", "text", F.col("n_removed")).collect()}
    assert got[1] == (text, 0) and got[2] == ("last", 60_000) and got[3][1] == 0
    assert time.perf_counter() - start < 90
