"""PrivTree over several columns: boxes of dyadic cells in the order of interleaved (Morton) codes.

A row's cell at the deepest level is one number, the bits of its place in each column interleaved. A node of the tree
at level k is the cells that share the first k times d bits, a range of these numbers; so one count of rows by
prefix serves a node and all nodes below it, and the leaves, in order, are ranges as well.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import expressions as X
from marginalia.plans.privacy import Noise

#: Bits of a code (a long) and cells that one pass counts at most for one asked node.
BITS, PASS_BITS = 62, 12


def places(columns: Mapping[str, tuple[str, float, float]], levels: int) -> list[Column]:
    """The place of a row in each column, 0 to 2**levels - 1 between the bounds, clipped. columns: name to (kind, low, high)."""
    n, out = float(1 << levels), []
    for c, (kind, lo, hi) in columns.items():
        x = X.to_number(F.col(f"`{c}`"), kind).cast("double")
        share = F.greatest((x - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))
        out.append(F.when(x.isNotNull() & ~F.isnan(x), F.least(F.floor(share * F.lit(n)), F.lit((1 << levels) - 1)).cast("long")))
    return out


def morton(columns: Mapping[str, tuple[str, float, float]], levels: int) -> Column:
    """The interleaved bits of a row's places; null where a column is null or no number."""
    at = places(columns, levels)
    d, chunk = len(at), min(8, levels)
    apart = [sum((x >> k & 1) << d * k for k in range(chunk)) for x in range(1 << chunk)]
    bits = lambda place, k: F.shiftright(place, k).bitwiseAND(F.lit((1 << chunk) - 1)).cast("int")
    # the bits of each chunk of a place, d apart
    spread = lambda place: reduce(Column.bitwiseOR, [F.shiftleft(X.lookup(bits(place, k), apart).cast("long"), d * k) for k in range(0, levels, chunk)])
    return reduce(Column.bitwiseOR, [F.shiftleft(X.let(place, spread), d - 1 - j) for j, place in enumerate(at)])


@dataclass
class Boxes:
    """Leaves in order: the first code of each at the deepest level, and its level."""

    columns: dict[str, tuple[str, float, float]]
    levels: int
    starts: list[int]
    depths: list[int]

    @property
    def n_bins(self) -> int:
        return len(self.starts)

    def code(self) -> Column:
        """The leaf of a row; null where a column has no number."""
        return X.let(morton(self.columns, self.levels), lambda at: F.when(at.isNotNull(), X.count_at_or_below(at, self.starts) - 1)).cast("int")

    def bounds(self, k: int) -> list[tuple[float, float]]:
        """The range of each column in a leaf."""
        d, depth = len(self.columns), self.depths[k]
        out = []
        for j, (_, lo, hi) in enumerate(self.columns.values()):
            place = 0
            for level in range(depth):
                place = 2 * place + (self.starts[k] >> (d * (self.levels - level) - 1 - j) & 1)
            width = (hi - lo) / 2.0**depth
            out.append((lo + place * width, lo + (place + 1) * width))
        return out

    def inverse(self, code: Column, row: Column, seed: int = 0) -> list[Column]:
        """A point of a leaf for each column: by hashes of the row, uniform in the box."""
        out = []
        for j, (c, (kind, _, _)) in enumerate(self.columns.items()):
            lows, highs = zip(*(self.bounds(k)[j] for k in range(self.n_bins)), strict=True)
            low, high = X.lookup(code, list(map(float, lows))), X.lookup(code, list(map(float, highs)))
            x = low + X.uniform(seed, f"box {c}", row) * (high - low)
            out.append((F.floor(x) if kind == "long" else x).alias(c))
        return out


def _counts(coded: DataFrame, d: int, levels: int, asked: Sequence[tuple[int, int]], steps: int) -> dict[int, dict[int, int]]:
    """For nodes (first code, level), all of one level: rows by their cell ``steps`` levels below, one job.

    The nodes are the borders of a search; rows outside all of them are dropped before they are counted.
    """
    level = asked[0][1]
    shift, width = d * (levels - level - steps), 1 << d * (levels - level)
    starts = sorted(s for s, _ in asked)
    k = X.count_at_or_below(F.col("_code"), starts) - 1
    start = X.lookup(F.greatest(k, F.lit(0)), starts)
    inside = (k >= 0) & (F.col("_code") < start + F.lit(width))
    cells = coded.where(inside).groupBy(k.alias("k"), F.shiftright(F.col("_code") - start, shift).alias("cell")).count()
    out: dict[int, dict[int, int]] = {s: {} for s, _ in asked}
    for r in cells.collect():
        out[starts[r["k"]]][r["cell"]] = r["count"]
    return out


def fit_boxes(df: DataFrame, columns: Mapping[str, tuple[str, float, float]], bins: int, eps: float | None, noise: Noise, cap: int | None = None) -> Boxes:
    """Grow a PrivTree whose nodes split at the midpoint of every column, into 2**d boxes.

    A node splits while max(count - depth * decay, theta - decay), with Laplace noise, is over theta = rows / bins;
    first in, first out, as long as there are no more than ``cap`` leaves (None: without end). Nodes of a level are
    taken together; where their counts are not known yet, one job counts the rows in the next levels below all of
    them (cells of rows only). A box narrower than BITS bits of interleaved places stays whole.
    """
    d = len(columns)
    levels = BITS // d
    steps = max(1, PASS_BITS // d)
    beta = 1 << d
    coded = df.select(morton(columns, levels).alias("_code")).where("_code is not null").persist()
    try:
        total = coded.count()
        theta = total / bins
        # the scale for a tree of fanout beta and the bias of a level, ln beta of it
        scale = (2 * beta - 1) / (beta - 1) / eps if eps else 0.0
        decay = scale * math.log(beta)
        leaves: list[tuple[int, int]] = []
        level, known, n = [(0, total)], {}, 1  # (first code, rows) of the nodes of a level
        for depth in range(levels + 1):
            split = []
            for start, rows in level:
                score = max(rows - depth * decay, theta - decay) + (float(noise.laplace(scale, 1)[0]) if eps else 0.0)
                if score > theta and depth < levels and (cap is None or n + beta - 1 <= cap):
                    split.append((start, rows))
                    n += beta - 1
                else:
                    leaves.append((start, depth))
            if not split:
                break
            if depth % steps == 0:
                below = min(steps, levels - depth)
                own = _counts(coded, d, levels, [(s, depth) for s, _ in split], below)
                known = {}
                for s, cells in own.items():
                    for cell, rows in cells.items():
                        known[s + (cell << d * (levels - depth - below))] = rows
                at = np.array(sorted(known), np.int64)
                summed = np.concatenate(([0], np.cumsum([known[x] for x in at.tolist()])))
            width = 1 << d * (levels - depth - 1)
            level = []
            for start, _ in split:
                for k in range(beta):
                    s = start + k * width
                    lo, hi = np.searchsorted(at, [s, s + width])
                    level.append((s, int(summed[hi] - summed[lo])))
    finally:
        coded.unpersist()
    leaves.sort()
    return Boxes(dict(columns), levels, [s for s, _ in leaves], [k for _, k in leaves])
