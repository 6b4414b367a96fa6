"""Column expressions: deterministic uniforms, codes of numeric and categorical columns and their inverses."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.types import Binning, Encoding

MICROS = 1_000_000


class UnsupportedTypeError(TypeError):
    """A column of a type that has neither a numeric nor a categorical reading."""


def kind_of(data_type: T.DataType) -> str | None:
    """Numeric kind of a Spark type; None for categorical ones; nested types are refused."""
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise UnsupportedTypeError(f"unsupported type {data_type.simpleString()}")
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    names = {T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz", T.DateType: "date", T.DayTimeIntervalType: "interval"}
    return next((n for t, n in names.items() if isinstance(data_type, t)), None)


def uniform(seed: int, salt: str, row: Column | str) -> Column:
    """Uniform in [0, 1) from (seed, salt, row): the same for every partitioning and retry."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), row), 11) * F.lit(2.0**-53)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def missing(c: Column, data_type: T.DataType) -> Column:
    """Null, or NaN of a floating column."""
    return c.isNull() | F.isnan(c) if isinstance(data_type, (T.FloatType, T.DoubleType)) else c.isNull()


def to_number(c: Column, kind: str) -> Column:
    """Doubles as they are, integers as they are, times in microseconds."""
    if kind == "double":
        return c.cast("double")
    if kind == "long":
        return c.cast("long")
    if kind == "date":
        return F.unix_date(c).cast("long") * F.lit(86_400 * MICROS)
    if kind == "interval":
        day = F.extract(F.lit("DAY"), c).cast("long") * 86_400
        return (day + F.extract(F.lit("HOUR"), c).cast("long") * 3600 + F.extract(F.lit("MINUTE"), c).cast("long") * 60) * MICROS + (F.extract(F.lit("SECOND"), c) * MICROS).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def from_number(x: Column, kind: str, data_type: T.DataType) -> Column:
    if kind == "double":
        return x.cast(data_type)
    if kind == "long":
        return F.round(x).cast("long").cast(data_type)
    whole = F.round(x).cast("long")
    if kind == "date":
        return F.date_from_unix_date(F.floor(whole / F.lit(86_400 * MICROS)).cast("int"))
    if kind == "interval":
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole / F.lit(MICROS)).cast("decimal(18,6)")).cast(data_type)
    return F.timestamp_micros(whole).cast(data_type)


def bin_code(x: Column, edges: Sequence[float]) -> Column:
    """Left-closed bin of x, clipped to the edges; null and NaN go to the last bin."""
    n = len(edges) - 1
    lo, hi = float(edges[0]), float(edges[-1])
    even = all(abs(e - (lo + (hi - lo) * k / n)) <= 1e-12 * max(1.0, abs(hi), abs(lo)) for k, e in enumerate(edges))
    v = x.cast("double")
    if n == 1 or hi <= lo:
        return F.lit(0)
    code = F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(n)).cast("int") - 1 if even else _search(v, [float(e) for e in edges[1:-1]], 0)
    code = F.least(F.greatest(code, F.lit(0)), F.lit(n - 1))
    return F.when(v.isNull() | F.isnan(v), F.lit(n - 1)).otherwise(code).cast("int")


def count_at_or_below(v: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are at or below v."""
    return _search(v, edges, 0)


#: Entries up to which a table is written out as an expression; longer ones are one literal array.
WRITTEN_OUT = 128


def _search(v: Column, inner: list[float], first: int) -> Column:
    """The number of inner edges at or below v: balanced comparisons, or a binary search of a literal array."""
    if not inner:
        return F.lit(first)
    if len(inner) > WRITTEN_OUT:
        table = literal_array(inner)
        strides = F.array(*[F.lit(1 << k) for k in range(len(inner).bit_length() - 1, -1, -1)])
        step = lambda at, stride: F.when((at + stride <= len(inner)) & (v >= F.get(table, at + stride - 1)), at + stride).otherwise(at)
        return F.aggregate(strides, F.lit(0), step) + F.lit(first)
    mid = len(inner) // 2
    return F.when(v >= F.lit(inner[mid]), _search(v, inner[mid + 1 :], first + mid + 1)).otherwise(_search(v, inner[:mid], first))


def allowed_pieces(b: Binning) -> list[list[tuple[float, float]]]:
    """For each bin the parts of it that no impossible interval covers; a bin that is covered whole stays whole."""
    out = []
    for lo, hi in zip(b.edges[:-1], b.edges[1:], strict=True):
        parts, at = [], lo
        for s, e in b.zeros:
            if e <= lo or s >= hi:
                continue
            if s > at:
                parts.append((at, s))
            at = max(at, min(e, hi))
        if at < hi:
            parts.append((at, hi))
        out.append(parts or [(lo, hi)])
    return out


def bin_value(code: Column, b: Binning, u: Column) -> Column:
    """A value of the bin: the point at share u of its allowed length. Whole numbers stay inside their piece.

    Pieces are rows of literal tables; only bins of several pieces are told apart by comparisons.
    """
    lows, highs, before, shares, first = [], [], [], [], []
    inner: list[tuple[int, list[float]]] = []
    for k, parts in enumerate(allowed_pieces(b)):
        length = sum(e - s for s, e in parts)
        first.append(len(lows))
        done, borders = 0.0, []
        for s, e in parts:
            share = (e - s) / length if length else 1.0
            low, high = (s, e) if b.kind == "double" else (_ceil(s), _floor(e, s))
            lows.append(float(low))
            highs.append(float(high))
            before.append(done)
            shares.append(share or 1.0)
            done += share
            borders.append(done)
        if len(parts) > 1:
            inner.append((k, borders[:-1]))
    at = lookup(code, first)
    for k, borders in inner:
        at = at + F.when(code == k, count_at_or_below(u, borders)).otherwise(0)
    low, high = lookup(at, lows), lookup(at, highs)
    x = low + (u - lookup(at, before)) / lookup(at, shares) * (high - low)
    return F.least(F.greatest(x, low), high)


def _ceil(x: float) -> float:
    return float(-(-x // 1))


def _floor(x: float, low: float) -> float:
    return max(float(x // 1), _ceil(low) if _ceil(low) <= x else low)


def encode(c: Column, e: Encoding, strict: bool = True) -> Column:
    """Code of a value: its place in the list. An unknown value raises, unless not strict (then null)."""
    if not e.values:
        return F.lit(0)
    literal = F.array(*[F.lit(v) for v in e.values])
    at = F.array_position(literal, c).cast("int")
    unknown = F.raise_error(F.concat(F.lit(f"unknown category in {e.column}: "), c.cast("string"))) if strict else F.lit(None).cast("int")
    return F.when(at > 0, at - 1).otherwise(unknown).cast("int")


def decode(code: Column, e: Encoding) -> Column:
    return F.get(F.array(*[F.lit(v) for v in e.values]), code) if e.values else F.lit(None)


def literal_array(table: Sequence) -> Column:
    """An array of constants; numbers are read from one constant, which the optimizer folds."""
    if len(table) <= 8 or not all(isinstance(x, (int, float)) for x in table):
        return F.array(*[F.lit(x) for x in table])
    kind = "double" if any(isinstance(x, float) for x in table) else "int" if max(map(abs, table)) < 2**31 else "bigint"
    return F.from_json(F.lit(json.dumps([float(x) if kind == "double" else x for x in table])), f"array<{kind}>")


def lookup(code: Column, table: Sequence) -> Column:
    """table[code] by a literal array."""
    return F.get(literal_array(table), code)
