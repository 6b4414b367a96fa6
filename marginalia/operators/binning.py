"""Fit and apply the discretisation of a whole table."""

from __future__ import annotations

import itertools
import json
import math
import warnings
from collections.abc import Generator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import expressions as X
from marginalia.operators.profile import bounds_histogram, distinct_values, private_bounds, profile
from marginalia.plans.privacy import Noise
from marginalia.types import Binning, ColumnSpec, Domain, Encoding

DEPTH = 12  # dyadic levels of a PrivTree histogram; a leaf that still wants to split is counted again, as deep
CELLS = 1 << 16  # cells that one pass counts at most for the leaves of a column
MAX_CATEGORIES = 10_000


def optimal_bins(n: int, upper: int | None = None, eps: float | None = None) -> int:
    """2 n^(1/3) bins; under a budget damped by its sigmoid, five at least; at most ``upper``."""
    bins = 2 * n ** (1 / 3)
    if eps is not None:
        bins = max(5, bins / (1 + math.exp(-eps)))
    return max(1, math.ceil(round(min(bins, upper) if upper else bins, 9)))


def uniform_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def merge_intervals(zeros) -> list[tuple[float, float]]:
    """Sorted, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    for s, e in sorted((float(a), float(b)) for a, b in zeros):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


Range = tuple[float, float]  # of positions: 0 to 2**DEPTH from the lower to the upper bound


@dataclass
class Cells:
    """Rows in equal cells between two positions, and the least and greatest position in each cell (if known)."""

    start: float
    width: float
    total: list[int]
    ends: dict[int, Range] = field(default_factory=dict)

    def at(self, k: int) -> float:
        return self.start + self.width * k

    def count(self, a: int, b: int) -> int:
        return self.total[b] - self.total[a]

    def finer(self, k: int) -> Cells | None:
        """The cells inside a cell whose rows share one value, without another count of the table."""
        if self.count(k, k + 1) and (k not in self.ends or self.ends[k][0] != self.ends[k][1]):
            return None
        n, start, width = 1 << DEPTH, self.at(k), self.width
        counts = [0] * n
        if rows := self.count(k, k + 1):
            counts[min(max(int((self.ends[k][0] - start) / width * n), 0), n - 1)] = rows
        return cells_of(start, width / n, counts, {c: self.ends[k] for c, x in enumerate(counts) if x})


def cells_of(start: float, width: float, counts: list[int], ends: dict[int, Range]) -> Cells:
    return Cells(start, width, [0, *itertools.accumulate(counts)], ends)


def grow(counts: list[int], low: float, high: float, bins: int, eps: float | None, noise: Noise, cap: int | None = None, deeper: bool = True) -> Generator[list[Range], list[Cells], list[float]]:
    """Edges of the leaves of a PrivTree; counts are those of 2**DEPTH equal cells.

    A node splits at its midpoint while max(count - depth * decay, theta - decay), with Laplace noise,
    is over theta = n / bins; first in, first out, until there are ``cap`` leaves (``bins`` unless given).
    That is level by level: where nodes of a level split inside a cell, their ranges are yielded, and the
    Cells of each are to be sent. Only a node without a number between its edges stays whole
    (and, unless ``deeper``, a cell of the counts).
    """
    cells = cells_of(0.0, 1.0, counts, {})
    theta = cells.count(0, len(counts)) / bins
    scale = 3.0 / eps if eps else 0.0
    decay = scale * math.log(2)
    step = (high - low) / len(counts)
    edge = lambda at: high if at >= len(counts) else low + step * at
    level, leaves, n, depth = [(cells, 0, len(counts))], [], 1, 0
    while level:
        split: list[tuple[Cells, int, int]] = []
        for own, a, b in level:
            count = own.count(a, b)
            score = max(count - depth * decay, theta - decay) + (float(noise.laplace(scale, 1)[0]) if eps else 0.0)
            middle = (own.at(a) + own.at(b)) / 2
            if score > theta and n < (cap or bins) and (deeper or b - a > 1) and edge(own.at(a)) < edge(middle) < edge(own.at(b)):
                split.append((own, a, b))
                n += 1
            else:
                leaves.append(own.at(a))
        inside = [own.finer(a) if b - a == 1 else own for own, a, b in split]
        asked = [(own.at(a), own.at(b)) for (own, a, b), known in zip(split, inside, strict=True) if known is None]
        counted = iter((yield asked) if asked else [])
        level = []
        for (own, a, b), known in zip(split, inside, strict=True):
            if b - a == 1:
                own = known or next(counted)
                a, b = 0, len(own.total) - 1
            level += [(own, a, (a + b) // 2), (own, (a + b) // 2, b)]
        depth += 1
    return [edge(at) for at in sorted(leaves)] + [high]


def private_tree(counts: list[int], low: float, high: float, bins: int, eps: float | None, noise: Noise, cap: int | None = None) -> list[float]:
    """Edges of the leaves of a PrivTree that stops at the cells of the counts."""
    try:
        next(grow(counts, low, high, bins, eps, noise, cap, deeper=False))
    except StopIteration as done:
        return done.value
    raise AssertionError("a tree of whole cells asks for no counts")


#: Ways to choose the edges of a numeric column.
BINNERS = ("uniform", "priv-tree")


@dataclass
class TableBinner:
    """Codes for a table of mixed types. ``epsilon`` pays for bounds and trees of numeric columns, split evenly;
    None is the noise-free mode. Only edges, categories and fill values are kept, never rows."""

    binner: str = "priv-tree"
    n_bins: int | str = "auto"
    epsilon: float | None = None
    domain: Mapping = field(default_factory=dict)
    zeros: Mapping = field(default_factory=dict)
    seed: int | None = None
    schema: T.StructType | None = None
    numeric: dict[str, Binning] = field(default_factory=dict)
    coded: dict[str, Encoding] = field(default_factory=dict)
    static: dict[str, object] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)
    spent: float = 0.0

    def __post_init__(self) -> None:
        if self.binner not in BINNERS:
            raise ValueError(f"no binner {self.binner}: {', '.join(BINNERS)}")

    def set_random_state(self, seed: int | None) -> TableBinner:
        """The seed of the noise and of the fill values from the next fit on."""
        self.seed = seed
        return self

    def set_params(self, **params) -> TableBinner:
        """Settings by name; a name that is none of them is an error."""
        for name, value in params.items():
            if name not in ("binner", "n_bins", "epsilon", "domain", "zeros", "seed"):
                raise ValueError(f"the binner has no parameter {name}")
            setattr(self, name, value)
        self.__post_init__()
        return self

    def fit(self, df: DataFrame, public: bool = False) -> TableBinner:
        """Jobs for all columns at once: profile, fills, bounds, trees; trees that go below DEPTH levels take another one
        for each DEPTH levels or so. The categories of all columns that list none take one more."""
        noise = Noise(self.seed)
        self.schema = df.schema
        self.numeric, self.coded, self.static, self.fills, self.flags, self.spent = {}, {}, {}, {}, {}, 0.0
        specs = {c: ColumnSpec.of(self.domain.get(c)) for c in df.columns}
        types = {f.name: f.dataType for f in df.schema.fields}
        found = profile(df)
        rows = next(iter(found.values())).rows if found else 0
        for c, p in found.items():
            if p.static:
                self.static[c] = None
            elif p.missing:
                self.flags[c] = _free_name(f"{c}_NaN", [*df.columns, *self.flags.values()])
        self._first_values(df, types)
        eps = None if public else self.epsilon
        numbers = [c for c, p in found.items() if c not in self.static and p.kind and specs[c].categories is None and p.distinct > 1]
        each = eps / len(numbers) if eps is not None and numbers else None
        texts = [c for c in df.columns if c not in self.static and c not in numbers]
        read = self._distinct(df, [c for c in texts if specs[c].categories is None], types)
        for c in texts:
            cats = specs[c].categories
            if cats is None:
                if not public:
                    warnings.warn(f"categories of {c} are read from the data, which leaks privacy; give a domain", stacklevel=2)
                cats = read[c]
            self.coded[c] = Encoding(c, sorted_categories(cats), list(self.zeros.get(c, [])))
        open_ = {c: found[c].kind for c in numbers if each is not None and (specs[c].lower is None or specs[c].upper is None)}
        histograms = bounds_histogram(df, open_)
        trees = {}
        for c in numbers:
            p, spec, left = found[c], specs[c], each
            lo, hi = (self._number(c, types[c], p.kind, v, df) for v in (spec.lower, spec.upper))
            if lo is None or hi is None:
                if each is None:
                    got = (p.low, p.high)
                else:
                    left = each / 2 if self.binner == "priv-tree" else each
                    got = private_bounds(histograms[c], left, noise)
                    self.spent += left
                    if got is None:
                        raise ValueError(f"no private bounds of {c} could be found: give lower and upper")
                lo, hi = got[0] if lo is None else lo, got[1] if hi is None else hi
            hi = max(float(hi), float(lo) + (0.0 if hi > lo else 1.0))
            bins = optimal_bins(rows, None if p.kind == "double" else max(1, int(hi - lo)), eps) if self.n_bins == "auto" else int(self.n_bins)
            zero = merge_intervals([(self._number(c, types[c], p.kind, s, df), self._number(c, types[c], p.kind, e, df)) for s, e in self.zeros.get(c, [])])
            self.numeric[c] = Binning(c, p.kind, uniform_edges(float(lo), float(hi), bins), self.binner, zero)
            if self.binner == "priv-tree":
                trees[c] = (float(lo), float(hi), bins, left)
        if trees:
            counts = dyadic_counts(df, {c: (self.numeric[c].kind, lo, hi) for c, (lo, hi, _, _) in trees.items()})
            for c, (lo, hi, bins, left) in trees.items():
                self.numeric[c].spent = left or 0.0
                self.spent += left or 0.0
            growing = {c: grow(counts[c], lo, hi, bins, left, noise) for c, (lo, hi, bins, left) in trees.items()}
            sent: dict[str, list[Cells] | None] = dict.fromkeys(growing)
            while sent:
                asked = {}
                for c, cells in sent.items():
                    try:
                        asked[c] = growing[c].send(cells)
                    except StopIteration as done:
                        self.numeric[c].edges = done.value
                sent = range_counts(df, {c: (self.numeric[c].kind, *trees[c][:2], ranges) for c, ranges in asked.items()}) if asked else {}
        return self

    def _number(self, c: str, data_type: T.DataType, kind: str, value, df: DataFrame) -> float | None:
        if value is None or isinstance(value, (int, float)):
            return value
        row = df.sparkSession.range(1).select(X.to_number(F.lit(value).cast(data_type), kind).alias("x")).first()
        return row["x"]

    def _first_values(self, df: DataFrame, types: dict) -> None:
        """Static values, and a fill for each column with missing values: the value whose hash is least."""
        wanted = [*self.static, *self.flags]
        if not wanted:
            return
        seed = self.seed or 0
        picks = []
        for k, c in enumerate(wanted):
            v = F.col(f"`{c}`")
            there = F.when(~X.missing(v, types[c]), v)
            picks.append(F.min_by(there, F.when(there.isNotNull(), F.xxhash64(F.lit(seed), there))).alias(f"v{k}"))
        row = df.agg(*picks).first()
        for k, c in enumerate(wanted):
            (self.static if c in self.static else self.fills)[c] = row[f"v{k}"]

    def _distinct(self, df: DataFrame, columns: list[str], types: dict) -> dict[str, list]:
        """The values of all columns without listed categories, from one job."""
        found = distinct_values(df, columns, MAX_CATEGORIES)
        for c, values in found.items():
            if values is None:
                raise ValueError(f"{c} has over {MAX_CATEGORIES} values: it is no category")
        out = {}
        for c, values in found.items():
            if isinstance(types[c], T.StringType):
                out[c] = values
            else:  # texts back to the column's type
                row = df.sparkSession.range(1).select(F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(types[c])).alias("v")).first()
                out[c] = row["v"]
        return out

    @property
    def codes(self) -> Domain:
        """The discrete domain of the coded table: categories first, then numbers, then flags."""
        sizes = {c: e.n_bins for c, e in self.coded.items()} | {c: b.n_bins for c, b in self.numeric.items()}
        return Domain.of(sizes | {f: 2 for f in self.flags.values()})

    def impossible(self) -> dict[str, list[int]]:
        """Codes that structural zeros cover: listed categories and bins inside an interval."""
        out = {c: [e.values.index(v) for v in e.impossible if v in e.values] for c, e in self.coded.items()}
        for c, b in self.numeric.items():
            out[c] = [k for k, (lo, hi) in enumerate(zip(b.edges[:-1], b.edges[1:], strict=True)) if any(s <= lo and hi <= e for s, e in b.zeros)]
        return {c: v for c, v in out.items() if v}

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """One select of compiled expressions; absent columns are skipped. ``keep`` names columns to carry along."""
        types = {f.name: f.dataType for f in self.schema.fields}
        out = [F.col(f"`{c}`") for c in keep]
        value = {}
        for c in df.columns:
            v = F.col(f"`{c}`")
            value[c] = F.when(X.missing(v, types[c]), F.lit(self.fills[c]).cast(types[c])).otherwise(v) if c in self.flags and c in types else v
        out += [X.encode(value[c], e).alias(c) for c, e in self.coded.items() if c in df.columns]
        out += [X.bin_code(X.to_number(value[c], b.kind), b.edges).alias(c) for c, b in self.numeric.items() if c in df.columns]
        out += [X.missing(F.col(f"`{c}`"), types[c]).cast("int").alias(f) for c, f in self.flags.items() if c in df.columns]
        return df.select(*out)

    def inverse(self, coded: DataFrame, row: str = "_row_id", seed: int = 0) -> DataFrame:
        """Values again, in the fitted order and types: a point of the bin by a hash of (seed, column, row)."""
        out = []
        for f in self.schema.fields:
            c = f.name
            if c in self.static:
                x = F.lit(self.static[c]).cast(f.dataType)
            elif c not in coded.columns:
                continue
            elif c in self.coded:
                x = X.decode(F.col(f"`{c}`"), self.coded[c]).cast(f.dataType)
            else:
                b = self.numeric[c]
                x = X.from_number(X.bin_value(F.col(f"`{c}`"), b, X.uniform(seed, c, F.col(row))), b.kind, f.dataType)
            if c in self.flags and self.flags[c] in coded.columns:
                x = F.when(F.col(f"`{self.flags[c]}`") == 0, x)
            out.append(x.alias(c))
        return coded.select(row, *out)

    def to_json(self) -> str:
        plain = lambda v: v if isinstance(v, (int, float, str, bool, type(None))) else {"text": str(v)}
        return json.dumps({
            "binner": self.binner, "n_bins": self.n_bins, "epsilon": self.epsilon, "seed": self.seed, "spent": self.spent, "schema": self.schema.jsonValue(),
            "numeric": [b.to_json() for b in self.numeric.values()], "coded": [{"column": e.column, "values": [plain(v) for v in e.values], "impossible": [plain(v) for v in e.impossible]} for e in self.coded.values()],
            "static": {c: plain(v) for c, v in self.static.items()}, "fills": {c: plain(v) for c, v in self.fills.items()}, "flags": self.flags,
        })

    @classmethod
    def from_json(cls, text: str) -> TableBinner:
        d = json.loads(text)
        back = lambda v: v["text"] if isinstance(v, dict) else v  # noqa: E731  literals are cast to the column's type
        out = cls(d["binner"], d["n_bins"], d["epsilon"], seed=d["seed"], schema=T.StructType.fromJson(d["schema"]), spent=d["spent"], flags=d["flags"])
        out.numeric = {b["column"]: Binning(**b | {"zeros": [tuple(z) for z in b["zeros"]]}) for b in d["numeric"]}
        out.coded = {e["column"]: Encoding(e["column"], [back(v) for v in e["values"]], [back(v) for v in e["impossible"]]) for e in d["coded"]}
        out.static, out.fills = ({c: back(v) for c, v in d[k].items()} for k in ("static", "fills"))
        return out


def _free_name(name: str, taken) -> str:
    """The name, with the first suffix _0, _1, ... that is free where it is taken."""
    if name not in taken:
        return name
    k = 0
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def sorted_categories(values) -> list:
    """By number if all are numbers, else by their text; nulls dropped."""
    there = [v for v in dict.fromkeys(values) if v is not None]
    return sorted(there) if all(isinstance(v, (int, float)) for v in there) else sorted(there, key=str)


def dyadic_counts(df: DataFrame, columns: Mapping[str, tuple[str, float, float]], depth: int = DEPTH) -> dict[str, list[int]]:
    """Rows in each of 2**depth equal cells between the bounds, clipped, for all columns in one job."""
    n = 1 << depth
    cells = []
    for c, (kind, lo, hi) in columns.items():
        x = X.to_number(F.col(f"`{c}`"), kind).cast("double")
        cell = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * n), F.lit(0)), F.lit(n - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("c"), F.when(~F.isnan(x), cell).alias("cell")))
    rows = df.select(F.explode(F.array(*cells)).alias("p")).where("p.cell is not null").groupBy("p.c", "p.cell").count().collect()
    out = {c: [0] * n for c in columns}
    for r in rows:
        out[r["c"]][r["cell"]] = r["count"]
    return out


def range_counts(df: DataFrame, columns: Mapping[str, tuple[str, float, float, list[Range]]], depth: int = DEPTH) -> dict[str, list[Cells]]:
    """The Cells of each of a column's ranges of positions (disjoint, of one width), for all columns in one job."""
    cells, parts = [], {}
    for c, (kind, lo, hi, ranges) in columns.items():
        starts, width = sorted(p for p, _ in ranges), ranges[0][1] - ranges[0][0]
        parts[c] = n = max(2, min(1 << depth, 1 << (CELLS // len(ranges)).bit_length() - 1))
        x = X.to_number(F.col(f"`{c}`"), kind).cast("double")
        last = float(1 << DEPTH)
        at = F.least(F.greatest((x - F.lit(lo)) / F.lit(hi - lo) * last, F.lit(0.0)), F.lit(math.nextafter(last, 0.0)))
        k = X.count_at_or_below(at, starts) - 1
        start = X.lookup(F.greatest(k, F.lit(0)), starts)
        cell = F.least(F.greatest(F.floor((at - start) / F.lit(width) * n), F.lit(0)), F.lit(n - 1)).cast("int")
        inside = ~F.isnan(x) & (k >= 0) & (at < start + F.lit(width))
        cells.append(F.struct(F.lit(c).alias("c"), F.when(inside, k).alias("k"), cell.alias("cell"), at.alias("at")))
    rows = df.select(F.explode(F.array(*cells)).alias("p")).where("p.k is not null").groupBy("p.c", "p.k", "p.cell").agg(F.count(F.lit(1)).alias("n"), F.min("p.at").alias("least"), F.max("p.at").alias("most")).collect()
    counts = {c: [[0] * parts[c] for _ in ranges] for c, (_, _, _, ranges) in columns.items()}
    ends: dict[str, list[dict[int, Range]]] = {c: [{} for _ in ranges] for c, (_, _, _, ranges) in columns.items()}
    for r in rows:
        counts[r["c"]][r["k"]][r["cell"]] = r["n"]
        ends[r["c"]][r["k"]][r["cell"]] = (r["least"], r["most"])
    out = {}
    for c, (_, _, _, ranges) in columns.items():
        place = {p: k for k, p in enumerate(sorted(p for p, _ in ranges))}
        out[c] = [cells_of(p, (q - p) / parts[c], counts[c][place[p]], ends[c][place[p]]) for p, q in ranges]
    return out
