"""Contingency tables: one by GROUP BY, many in one pass."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.expressions import lookup, uniform
from marginalia.operators.cut import cut
from marginalia.plans.factors import Factor, SparseFactor
from marginalia.types import Clique, Domain

if TYPE_CHECKING:
    from marginalia.plans.compression import Compressor

#: Cells that a task holds in arrays, in all and of one clique; other cliques are added up by their distinct cells.
CELLS_A_PASS, DENSE_CELLS = 8_000_000, 2_000_000
ROWS_A_PASS = 1 << 17
#: Cells of a whole domain up to which rows are added up to its occupied cells once, before any clique is counted.
CELLS_FIRST = 1 << 16


def cell_id(clique: Sequence[str], domain: Domain) -> Column:
    """Mixed-radix number of a row's cell."""
    out = F.lit(0).cast("long")
    for a in clique:
        out = out * F.lit(domain[a]) + F.col(f"`{a}`").cast("long")
    return out


def marginal(df: DataFrame, columns: Sequence[str], weight: str | None = None, name: str = "n") -> DataFrame:
    """GROUP BY with a count, or a sum of weights."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*columns).agg(measure.alias(name))


def occupied(df: DataFrame, domain: Domain, weight: str | None = None) -> tuple[DataFrame, str]:
    """The occupied cells of the whole domain and the column that holds their rows or weights: every marginal of the rows
    is one of these. A weight that is null makes its cell's NaN, as it does where rows are counted by themselves."""
    name = next(n for n in (f"_n{'_' * k}" for k in range(len(domain.attrs) + 1)) if n not in domain)
    measure = F.count(F.lit(1)) if weight is None else F.sum(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(float("nan"))))
    return df.groupBy(*[F.col(f"`{a}`") for a in domain]).agg(measure.alias(name)), name


def dense_marginal(df: DataFrame, columns: Sequence[str], domain: Domain, name: str = "n") -> DataFrame:
    """A marginal with its zero cells, as a left join from the grid of cells (the grid's size is the domain's)."""
    grid = df.sparkSession.range(domain.size(columns))
    out, left = grid.select(F.col("id").alias("_cell")), domain.size(columns)
    for a in columns:
        left //= domain[a]
        out = out.withColumn(a, F.pmod(F.floor(F.col("_cell") / left), F.lit(domain[a])).cast("int"))
    counts = df.groupBy(cell_id(columns, domain).alias("_cell")).agg(F.count(F.lit(1)).alias(name))
    return out.join(counts, "_cell", "left").select(*columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def cell_counts(df: DataFrame, cliques: Sequence[Clique], domain: Domain, weight: str | None = None) -> DataFrame:
    """(clique, cell, n): the occupied cells of many cliques from one pass, the clique by its place in the list.

    Each task adds its rows up by clique, cliques of up to DENSE_CELLS cells in an array, others by their distinct
    cells in every ROWS_A_PASS rows, and emits the cells that are not zero; a sum by (clique, cell) follows.
    """
    attrs = [a for a in domain if any(a in c for c in cliques)]
    at = {a: k for k, a in enumerate(attrs)}
    plan = [(k, [(at[a], domain[a]) for a in c], domain.size(c)) for k, c in enumerate(cliques)]
    if any(n >= 1 << 62 for _, _, n in plan):
        raise ValueError("a clique has more cells than a long can number")
    dense, room = set(), CELLS_A_PASS
    for k, _, n in plan:
        if n <= min(DENSE_CELLS, room):
            dense.add(k)
            room -= n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(n) for k, _, n in plan if k in dense}

        def told(k: int, cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(n)], ["clique", "cell", "n"])

        def add(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            codes = [t.column(k).to_numpy().astype(np.int64) for k in range(len(attrs))]
            w = t.column(len(attrs)).to_numpy().astype(float) if weight else None
            for k, steps, n in plan:
                cell = np.zeros(t.num_rows, np.int64)
                for a, radix in steps:
                    cell = cell * radix + codes[a]
                if k in sums and n <= 2 * t.num_rows:
                    sums[k] += np.bincount(cell, weights=w, minlength=n)
                    continue
                own, of = np.unique(cell, return_inverse=True)
                many = np.bincount(of, weights=w, minlength=len(own)).astype(float)
                if k in sums:
                    sums[k][own] += many
                else:
                    yield told(k, own, many)

        # batches of any size are added up ROWS_A_PASS rows at a time
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS_A_PASS:
                yield from add(held)
                held = []
        if held:
            yield from add(held)
        for k, s in sums.items():
            there = np.flatnonzero(s)
            if len(there):
                yield told(k, there, s[there])

    columns = [F.col(f"`{a}`").cast("int").alias(f"c{k}") for k, a in enumerate(attrs)] + ([F.col(weight).cast("double").alias("w")] if weight else [])
    if not columns:
        columns = [F.lit(0).alias("c0")]
    return df.select(*columns).mapInArrow(run, "clique int, cell long, n double").groupBy("clique", "cell").agg(F.sum("n").alias("n"))


def count_cells(df: DataFrame, cliques: Iterable[Clique], domain: Domain, weight: str | None = None) -> dict[Clique, SparseFactor]:
    """Counts of many cliques from one job. Only the largest are counted; a clique within another is its sum.

    What comes to the driver are the occupied cells of the largest cliques, whatever their sizes and the rows.
    """
    wanted = list(dict.fromkeys(tuple(c) for c in cliques))
    largest = rolled_up(wanted)
    got = cell_counts(df, largest, domain, weight).toArrow()
    which, cell, n = (got.column(c).to_numpy() for c in ("clique", "cell", "n"))
    order = np.argsort(which, kind="stable")
    borders = np.searchsorted(which[order], np.arange(len(largest) + 1))
    found = {c: SparseFactor(domain.project(c), cell[order[s:e]], n[order[s:e]]) for c, s, e in zip(largest, borders[:-1], borders[1:], strict=True)}
    for c in sorted(wanted, key=len, reverse=True):
        if c not in found:  # from the smallest table that holds it
            found[c] = min((f for d, f in found.items() if set(c) <= set(d)), key=lambda f: len(f.cells)).project(c)
    return {c: found[c] for c in wanted}


def rolled_up(cliques: Sequence[Clique]) -> list[Clique]:
    """The cliques that no other one holds (of two orders of the same attributes the first)."""
    return [c for k, c in enumerate(cliques) if not any(set(c) < set(d) or (set(c) == set(d) and j < k) for j, d in enumerate(cliques))]


class TableCounts:
    """True marginals of coded rows, as the strategies ask for them. Each call is one job."""

    def __init__(self, df: DataFrame, domain: Domain, weight: str | None = None):
        self.df, self.domain, self.weight = df, domain, weight

    def __call__(self, cliques: Iterable[Clique]) -> dict[Clique, SparseFactor]:
        return count_cells(self.df, cliques, self.domain, self.weight)

    def compressed(self, compressor: Compressor) -> TableCounts:
        """The same rows in compressed codes: literal tables that the next job maps them by."""
        other = [self.weight] if self.weight else []
        return TableCounts(self.df.select(*[compressor.transform(a).alias(a) for a in compressor.small], *other), compressor.small, self.weight)

    def pair_errors(self, pairs: Sequence[Clique], ones: Mapping[str, np.ndarray], total: float) -> dict[Clique, float]:
        """L1 distance of each pair's table to the product of its one-way tables (each of ``total`` in all).

        The tables stay in Spark: their occupied cells are met with what is expected there, empty cells hold what is
        left of the total, and a number for each pair comes back. What is sent to the tasks are the one-way tables.
        """
        if not pairs:
            return {}
        domain = self.domain

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far, mass = np.zeros(len(pairs)), np.zeros(len(pairs))
            for b in batches:
                which, cell, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                for k in np.unique(which):
                    own = which == k
                    i, j = np.divmod(cell[own], domain[pairs[k][1]])
                    e = ones[pairs[k][0]][i] * ones[pairs[k][1]][j] / total
                    far[k] += np.abs(n[own] - e).sum()
                    mass[k] += e.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(far), pa.array(mass)], ["clique", "far", "mass"])

        cells = cell_counts(self.df, pairs, domain, self.weight)
        parts = cells.mapInArrow(run, "clique int, far double, mass double").groupBy("clique").agg(F.sum("far").alias("far"), F.sum("mass").alias("mass"))
        found = {r["clique"]: r["far"] + max(0.0, total - r["mass"]) for r in parts.collect()}
        return {p: found.get(k, total) for k, p in enumerate(pairs)}


def cube(df: DataFrame, attrs: Sequence[str], weight: str | None = None, name: str = "n") -> DataFrame:
    """(attributes, level, n): the tables of all sets of the attributes, with nulls where an attribute is summed out.

    ``level`` is the grouping number: bit k from the right is set where the k-th attribute from the last is summed
    out, which tells a summed-out attribute from a null of the data. Rows are added up to cells first, so that the
    2^d sets are made of cells; table by table every row would be read and grouped 2^d times.
    """
    cells = marginal(df, list(attrs), weight, name)
    return cells.cube(*attrs).agg(F.grouping_id().cast("long").alias("level"), F.sum(name).alias(name))


def redraw(df: DataFrame, impossible: Mapping[str, Sequence[int]], domain: Domain, seed: int | None = 0, row: str | None = None) -> DataFrame:
    """Impossible codes replaced by possible ones, each row's drawn evenly and by itself.

    The draws come from a number of the row (``row``, or one that is given here and written once, so that
    every reading of the rows sees the same draws), never from what rows hold: equal rows go to different codes,
    and one row's change moves no other. seed None: the system's entropy.
    """
    seed = int.from_bytes(os.urandom(4), "big") if seed is None else seed
    left = {a: [k for k in range(domain[a]) if k not in set(codes)] for a, codes in impossible.items()}
    for a, codes in left.items():
        if not codes:
            raise ValueError(f"no code of {a} is possible")
    left = {a: codes for a, codes in left.items() if len(codes) < domain[a]}
    if not left:
        return df
    number = row or next(n for n in (f"_row{'_' * k}" for k in range(len(df.columns) + 1)) if n not in df.columns)
    out = df if row else cut(df.withColumn(number, F.monotonically_increasing_id()))
    new = {}
    for a, codes in left.items():
        pick = F.least(F.floor(uniform(seed, f"possible {a}", F.col(f"`{number}`")) * len(codes)).cast("int"), F.lit(len(codes) - 1))
        new[a] = F.when(F.col(f"`{a}`").isin(sorted(set(impossible[a]))), lookup(pick, codes)).otherwise(F.col(f"`{a}`")).cast("int").alias(a)
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns])


def check_types(df: DataFrame, domain: Domain) -> None:
    """Raises ValueError where a column of the domain is absent or not whole-numbered."""
    types = dict(df.dtypes)
    for a in domain:
        if a not in types:
            raise ValueError(f"column {a} is missing")
        if types[a] not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"column {a} must hold integers, not {types[a]}")


def check_codes(df: DataFrame, domain: Domain) -> None:
    """Raises ValueError where a column of the domain is absent, not whole-numbered, null, negative or too large."""
    check_types(df, domain)
    aggs = []
    for k, a in enumerate(domain):
        c = F.col(f"`{a}`")
        aggs += [F.sum(c.isNull().cast("long")).alias(f"n{k}"), F.min(c).alias(f"l{k}"), F.max(c).alias(f"h{k}")]
    row = df.agg(*aggs).first()
    for k, a in enumerate(domain):
        if row[f"n{k}"]:
            raise ValueError(f"column {a} holds nulls")
        if row[f"l{k}"] is not None and (row[f"l{k}"] < 0 or row[f"h{k}"] >= domain[a]):
            raise ValueError(f"column {a} holds codes outside 0..{domain[a] - 1}")


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in bits; empty cells are skipped."""
    p = counts[counts > 0] / counts.sum() if counts.sum() else np.ones(1)
    return float(-(p * np.log2(p)).sum())


def mutual_information(joint: Factor | SparseFactor, child: str) -> float:
    """Normalised: (H(child) + H(parents) - H(both)) / sqrt(H(child) H(parents)); 0 where either is 0.

    Of a sparse table only the occupied cells are looked at.
    """
    held = lambda f: f.numbers if isinstance(f, SparseFactor) else f.datavector()
    parents = [a for a in joint.domain if a != child]
    h_child = entropy(held(joint.project(child)))
    h_parents = entropy(held(joint.project(parents))) if parents else 0.0
    return (h_child + h_parents - entropy(held(joint))) / float(np.sqrt(h_child * h_parents)) if h_child > 0 and h_parents > 0 else 0.0


# Factors as tables (attributes and "value"): joins by the shared attributes.


#: Cells of a product of two tables that share no attribute.
PRODUCT_CELLS = 10_000_000


def factor_product(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Natural join on the shared attributes, values multiplied.

    Tables without a shared attribute have every pair of their cells as their product: they are counted, and more
    than PRODUCT_CELLS pairs are an error.
    """
    shared = [c for c in a.columns if c in b.columns and c != value]
    right = b.withColumnRenamed(value, "_v")
    if not shared:
        n, m = a.count(), b.count()
        if n * m > PRODUCT_CELLS:
            raise ValueError(f"tables of {n} and {m} cells share no attribute: their product has too many")
        joined = a.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")
    else:
        joined = a.join(right, shared)
    return joined.withColumn(value, F.col(value) * F.col("_v")).drop("_v")


def factor_divide(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Left join on the divisor's attributes; 0 where the divisor is absent or not positive."""
    shared = [c for c in b.columns if c != value]
    joined = a.join(b.withColumnRenamed(value, "_v"), shared, "left")
    return joined.withColumn(value, F.when(F.col("_v") > 0, F.col(value) / F.col("_v")).otherwise(0.0)).select(*a.columns)


def factor_condition(a: DataFrame, evidence: dict) -> DataFrame:
    out = a
    for k, v in evidence.items():
        out = out.where(F.col(k) == F.lit(v))
    return out.drop(*evidence)


def factor_sum(a: DataFrame, keep: Sequence[str], value: str = "value", how: str = "sum") -> DataFrame:
    return a.groupBy(*keep).agg(getattr(F, how)(value).alias(value))
