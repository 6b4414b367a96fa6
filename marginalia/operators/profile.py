"""One pass over a table: rows, missing values, distinct values, least and greatest of each column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.expressions import kind_of, missing, to_number
from marginalia.plans.privacy import Noise


@dataclass
class ColumnProfile:
    kind: str | None
    rows: int
    missing: int
    distinct: int  # of values that are there
    low: float | None
    high: float | None

    @property
    def static(self) -> bool:
        """One value, nulls counted as one."""
        return self.distinct + (self.missing > 0) <= 1


def _values(df: DataFrame, columns: Sequence[str], types: dict[str, T.DataType]) -> DataFrame:
    """(c, v): the distinct values of all columns, as text, by the place of their column in the list: one shuffle of
    values that each task has made distinct first."""
    each = []
    for k, c in enumerate(columns):
        col = F.col(f"`{c}`")
        each.append(F.struct(F.lit(k).alias("c"), F.when(~missing(col, types[c]), _plain(col, types[c]).cast("string")).alias("v")))
    return df.select(F.explode(F.array(*each)).alias("e")).select("e.c", "e.v").where("v is not null").distinct()


def _plain(col: Column, data_type: T.DataType) -> Column:
    """Equal numbers as equal texts: -0.0 is 0.0."""
    return col + F.lit(0.0).cast(data_type) if isinstance(data_type, (T.FloatType, T.DoubleType)) else col


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many values each column has, nulls and NaN apart, for all columns in one job."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {r["c"]: r["n"] for r in _values(df, columns, types).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(k, 0) for k, c in enumerate(columns)}


def distinct_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list | None]:
    """The values of each column that has ``limit`` at most, None for the others: one job for all columns.

    A task ends a column's list one value beyond the limit, which is enough to tell that there are more, so no
    column sends more than that from a task; the lists come together a column at a time, bounded by the same.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = df.select(*[F.when(~missing(F.col(f"`{c}`"), types[c]), _plain(F.col(f"`{c}`"), types[c])).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[set] = [set() for _ in columns]
        for b in batches:
            for k, own in enumerate(known):
                if len(own) <= limit:
                    new = [v for v in b.column(k).unique().to_pylist() if v is not None and v not in own]
                    own.update(new[: limit + 1 - len(own)])
        for k, own in enumerate(known):
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(sorted(own), pa.string())], ["c", "v"])

    found = plain.mapInArrow(run, "c int, v string").distinct()
    place = F.row_number().over(W.partitionBy("c").orderBy("v"))
    rows = found.withColumn("_k", place).where(F.col("_k") <= limit + 1).select("c", "v").collect() if columns else []
    out: dict[str, list | None] = {c: [] for c in columns}
    for r in rows:
        out[columns[r["c"]]].append(r["v"])
    return {c: vs if len(vs) <= limit else None for c, vs in out.items()}


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> dict[str, ColumnProfile]:
    """Profiles by column from a single job. Whether a column holds two values is exact; the number of
    them is estimated, so that no column's values are shuffled whole, unless ``exact`` (one more job)."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [F.count(F.lit(1)).alias("_rows")]
    kinds = {}
    for k, c in enumerate(columns):
        col = F.col(f"`{c}`")
        kinds[c] = kind_of(types[c])
        there = F.when(~missing(col, types[c]), col)
        value = to_number(there, kinds[c]) if kinds[c] else there.cast("string")
        out += [F.sum(missing(col, types[c]).cast("long")).alias(f"n{k}"), F.min(value).alias(f"l{k}"), F.max(value).alias(f"h{k}")]
        if not exact:
            out.append(F.approx_count_distinct(value).alias(f"d{k}"))
    row = df.agg(*out).first()
    many = distinct_counts(df, columns) if exact else {c: row[f"d{k}"] for k, c in enumerate(columns)}
    found = {}
    for k, c in enumerate(columns):
        lo, hi, n = row[f"l{k}"], row[f"h{k}"], row["_rows"]
        distinct = 0 if lo is None else 1 if lo == hi else max(2, many[c])
        found[c] = ColumnProfile(kinds[c], n, row[f"n{k}"] or 0, distinct, *((lo, hi) if kinds[c] else (None, None)))
    return found


def power_bin(x: Column) -> Column:
    """Signed power-of-two bin of a number: 0 for |x| < 1, else sign * (1 + floor(log2 |x|))."""
    a = F.abs(x.cast("double"))
    return F.when(a < 1, F.lit(0)).otherwise(F.signum(x.cast("double")).cast("int") * (F.floor(F.log2(a)).cast("int") + 1))


def bounds_histogram(df: DataFrame, columns: dict[str, str]) -> dict[str, dict[int, int]]:
    """Rows in each signed power-of-two bin, for all columns in one job. columns: name to kind."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), power_bin(to_number(F.col(f"`{c}`"), k)).alias("b")) for c, k in columns.items()])
    rows = df.select(F.explode(pairs).alias("p")).where("p.b is not null").groupBy("p.c", "p.b").count().collect()
    out: dict[str, dict[int, int]] = {c: {} for c in columns}
    for r in rows:
        out[r["c"]][r["b"]] = r["count"]
    return out


def private_bounds(histogram: dict[int, int], eps: float | None, noise: Noise, bins: int = 64) -> tuple[float, float] | None:
    """Outermost bins whose noisy count passes a threshold that an empty bin passes rarely; None if none does."""
    ids = np.arange(-bins, bins + 1)
    counts = np.array([histogram.get(int(i), 0) for i in ids], float)
    if eps is None:
        there = np.flatnonzero(counts > 0)
    else:
        scale = 1 / eps
        limit = scale * float(np.log(len(ids) / (2 * 1e-9)) ) if eps > 0 else np.inf
        there = np.flatnonzero(counts + noise.laplace(scale, len(ids)) > limit)
    if not len(there):
        return None
    edge = lambda i, up: 1.0 * up if i == 0 else float(2.0 ** i if up > 0 else 2.0 ** (i - 1)) if i > 0 else -float(2.0 ** (-i - 1) if up > 0 else 2.0 ** (-i))
    return edge(int(ids[there[0]]), -1), edge(int(ids[there[-1]]), 1)
