"""Vector codes against plain Lloyd in whole numbers; bounds, ties, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import codes


def _plain(rows, rounds=codes.ROUNDS):
    """(code, error) by row number and the final codebooks, in Python's integers."""
    kept = [(k, i, [math.floor(1024 * float(x)) for x in v]) for k, (i, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    d = len(first[0][2])
    kept = [r for r in kept if len(r[2]) == d]
    each = d // 4
    cut = lambda v: [v[p * each : (p + 1) * each] for p in range(4)]
    books = [[cut(r[2])[p] for r in first if len(r[2]) == d][:256] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        own = {r[0]: [min((far(x, c), j) for j, c in enumerate(books[p])) for p, x in enumerate(cut(r[2]))] for r in kept}
        for p in range(4) if k < rounds else ():
            for j in range(len(books[p])):
                mine = [cut(r[2])[p] for r in kept if own[r[0]][p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return {k: ([j for _, j in v], sum(e for e, _ in v)) for k, v in own.items()}, np.array(books)


def _rows(kind):
    rng = np.random.default_rng(11)
    n, d = (420, 8) if kind != "few" else (40, 12)
    x = rng.normal(size=(n, d)) * 0.3
    if kind == "ties":  # points of a coarse grid: most distances tie
        x = rng.integers(-2, 3, size=(n, d)) / 256
    if kind == "copies":  # a third of all rows is one vector, another third lies close round it
        x[: n // 3] = x[0]
        x[n // 3 : 2 * n // 3] = x[0] + rng.normal(size=(2 * n // 3 - n // 3, d)) / 500
    if kind == "wide":
        x = x * 10.0 ** rng.integers(-3, 5, size=(n, 1))
    ids = rng.permutation(n).tolist() if kind != "ties" else (np.arange(n) // 3).tolist()
    rows = [(i, list(map(float, v)), int(k) % 3 or None) for k, (i, v) in enumerate(zip(ids, x, strict=True))]
    odd = [(-9, None, 1), (-8, [float("nan")] * d, 1), (-7, [1.0, None] * (d // 2), None), (-6, [float("inf")] + [0.0] * (d - 1), 2), (-5, [], 1), (9999, [1.0] * (d + 4), 1), (None, [0.5] * d, None), (None, [0.5] * d, 1)]
    return rows + odd


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "few", "wide"])
def test_codes_are_those_of_plain_lloyd(spark, kind):
    rows = _rows(kind)
    want, books = _plain(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    done = codes.encode(docs)
    assert np.array_equal(done.codebooks, books)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["label"] or 0, tuple(r["entry"]), r["error"]) for r in done.rows.collect())
    assert got == sorted((rows[k][0] is None, rows[k][0] or 0, rows[k][2] or 0, tuple(e), far) for k, (e, far) in want.items())
    by_label = {}
    for k, (_, far) in want.items():
        by_label[rows[k][2]] = by_label.get(rows[k][2], 0) + far
    assert all(r["label_error"] == by_label[r["label"]] for r in codes.label_errors(done).collect())


def test_bounds_hold_and_spare_groups():
    """Every bound lies below the distance to each entry of its group but the row's own; most groups are not searched."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, size=(40, 16))
    x = centres[rng.integers(40, size=6000)] + rng.integers(-60, 61, size=(6000, 16))
    entries, before = x[:256].copy(), None
    groups = codes.group_of(entries)
    own, bounds = np.zeros(len(x), np.int64), np.full((len(x), groups.max() + 1), -1, np.int64)
    for k in range(5):
        book = codes.Codebook(entries, groups, before)
        own, far, bounds = book.assign(x, own, bounds)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(own, d.argmin(axis=1)) and np.array_equal(far, d.min(axis=1))
        others = d.astype(float)
        others[np.arange(len(x)), own] = np.inf
        for g, m in enumerate(book.members):
            assert (bounds[:, g].astype(float) ** 2 <= others[:, m].min(axis=1)).all()
        before = entries
        entries = np.stack([np.floor_divide(x[own == j].sum(axis=0), max(1, (own == j).sum())) if (own == j).any() else entries[j] for j in range(256)])
        if k:
            assert book.scanned < book.asked / 2
    assert book.scanned < book.asked / 5


def test_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label string, entry int, error string, v int"
    empty = codes.encode(spark.createDataFrame([], shape))
    assert codes.label_errors(empty).count() == 0 and empty.codebooks.shape[1] == 0 and len(empty.digest) == 64
    nothing = codes.encode(spark.createDataFrame([(1, None, "a", 1, "x", 2)], shape))
    assert nothing.rows.count() == 0
    one = codes.encode(spark.createDataFrame([(1, [0.5, -0.25, 1e-9, -1e-9], "a", 1, "x", 2)], shape))
    assert [tuple(r) for r in one.rows.collect()] == [(1, "a", [0, 0, 0, 0], 0)]
    assert one.codebooks.ravel().tolist() == [512, -256, 0, -1]
    # beyond what a long may hold: dropped
    far = codes.encode(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], "a", 1, "x", 2), (2, [1.0] * 4, None, 1, "x", 2)], shape))
    assert codes.label_errors(far).select("vec_id", F.col("label_error")).collect() == [(2, 0)]
