"""Vector codes of a product quantiser that is trained on every row, by Yinyang Lloyd in integers.

A vector's components become integers and are cut into PARTS equal parts, each with a codebook of its own.
The entries of a codebook are clustered into groups once. Every part of every row keeps its entry and, for each
group, a lower bound (an integer, rounded down) of its distance to the group's entries other than its own. When
the codebook moves, the bound of a group falls by the farthest move in it; only where the distance to the own
entry, which is computed anew, does not lie below a bound are that group's entries looked at again (Ding et al.,
"Yinyang K-Means", 2015). Distances are found in doubles and those that could tie or be the least are computed
again in integers, so that ties go to the lower index exactly.

A round is one Spark job over rows that are written to the shared folder (vector, entries and bounds), with the
codebooks sent to the tasks: PARTS * ENTRIES entries, whatever the input. Sums by entry are added up in each task
first and by Spark after that; what comes to the driver is one row for each component of the codebooks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import remove, shared_folder, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of a codebook's entries, and the rounds of k-means that find them.
GROUPS, GROUP_ROUNDS = 16, 8
#: Rows that a task works on at once.
ROWS = 8192


def widest(d: int) -> float:
    """Integer components beyond this, in d places, may have a squared distance that no long holds."""
    return float(np.floor(np.sqrt(2.0**61 / max(d, 1))))


def _ints(batch: pa.Array, d: int) -> np.ndarray:
    return np.asarray(batch.flatten(), np.int64).reshape(len(batch), d)


def _lists(x: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.ravel()))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows of the same place, in integers."""
    d = x - y
    return (d * d).sum(axis=1)


def group_of(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry: k-means of the entries themselves, from evenly spaced ones."""
    e = entries.astype(float)
    k = max(1, min(groups, len(e)))
    centres = e[np.linspace(0, len(e) - 1, k).astype(int)] if len(e) else e
    own = np.zeros(len(e), np.int64)
    for _ in range(GROUP_ROUNDS if len(e) else 0):
        own = ((e[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([e[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(k)])
    return own


class Codebook:
    """One part's entries, their groups, and how far each entry has moved since the bounds were made."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.members = entries, [np.flatnonzero(groups == g) for g in range(int(groups.max(initial=0)) + 1)]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(squared(entries, before).astype(float))
        # rounded up, as bounds must not stay too high
        self.drift = np.array([np.ceil(moved[m].max(initial=0.0) * (1 + 1e-12)) for m in self.members]).astype(np.int64)
        self.groups, self.scanned, self.asked = groups, 0, 0

    def _near(self, x: np.ndarray, norms: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the members in doubles, and how far each row's may be off."""
        e = self.entries[members].astype(float)
        size = (e * e).sum(axis=1)
        d = norms[:, None] - 2 * (x.astype(float) @ e.T) + size[None, :]
        # integers below 2^53 are exact in any order of summing
        total = norms + size.max(initial=0.0) + 2 * np.sqrt(norms * size.max(initial=0.0))
        return d, np.where(total < 2.0**52, 0.0, total * (4 + x.shape[1]) * 2.0**-52)

    def assign(self, x: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, bounds) of each row of a part, from those of the round before."""
        mine, bounds = own.copy(), np.maximum(bounds - self.drift[None, :], -1)
        norms = (x.astype(float) ** 2).sum(axis=1)
        mine_at = squared(x, self.entries[own])
        started = bounds.max(axis=1, initial=-1) < 0  # rows without bounds, as in the first round, search every group
        for g, members in enumerate(self.members):
            # a bound that the distance does not lie below fails: some entry may be as near
            failing = np.flatnonzero(started | (bounds[:, g].astype(float) <= np.sqrt(mine_at.astype(float)) * (1 + 1e-12)))
            self.asked += len(x) * len(members)
            self.scanned += len(failing) * len(members)
            if not len(failing) or not len(members):
                continue
            part = x[failing]
            d, off = self._near(part, norms[failing], members)
            low = d.min(axis=1)
            # entries that may be the nearest of the group, in the order of their indexes: verified in integers
            close = d <= (low + 2 * off)[:, None]
            row, col = np.nonzero(close)
            exact = squared(part[row], self.entries[members[col]])
            order = np.lexsort((members[col], exact, row))
            first = order[np.concatenate(([True], np.diff(row[order]) > 0))]
            at, entry = exact[first], members[col[first]]
            better = (at < mine_at[failing]) | ((at == mine_at[failing]) & (entry < mine[failing]))
            # the bound is of the others than the row's own entry, which may be of this group
            d[np.flatnonzero(better), col[first][better]] = np.inf
            at_own = np.searchsorted(members, mine[failing])
            holds = ~better & (at_own < len(members)) & (members[np.minimum(at_own, len(members) - 1)] == mine[failing])
            d[np.flatnonzero(holds), at_own[holds]] = np.inf
            second = d.min(axis=1)
            bounds[failing, g] = _floor_root(second - off)
            # an entry that is left behind is one of the others of its group from now on
            left = failing[better]
            back = self.groups[mine[left]]
            root = _floor_root(mine_at[left].astype(float))
            bounds[left, back] = np.minimum(bounds[left, back], root)
            mine[left], mine_at[left] = entry[better], at[better]
        return mine, mine_at, bounds


def _floor_root(d: np.ndarray) -> np.ndarray:
    """A whole number that the root of d is not below; where nothing is left (infinite) one beyond all distances of moment."""
    return np.floor(np.sqrt(np.clip(d, 0.0, 2.0**60)) * (1 - 1e-12)).astype(np.int64)


def _assign(books: list[Codebook], d: int):
    """Rows with the state of the round before: the same with the entries and bounds of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = d // PARTS
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                x = _ints(b.column("v"), d)
                n = len(x)
                first = b.column("entry").null_count == n
                own = np.zeros((n, PARTS), np.int64) if first else _ints(b.column("entry"), PARTS)
                t = [len(k.members) for k in books]
                bounds = np.full((n, sum(t)), -1, np.int64) if first else _ints(b.column("bounds"), sum(t))
                error = np.zeros(n, np.int64)
                at = 0
                new, held = np.empty_like(own), np.empty_like(bounds)
                for p, book in enumerate(books):
                    new[:, p], far, held[:, at : at + t[p]] = book.assign(x[:, p * each : (p + 1) * each], own[:, p], bounds[:, at : at + t[p]])
                    error += far
                    at += t[p]
                out = {"vec_id": b.column("vec_id"), "label": b.column("label"), "v": b.column("v"), "entry": _lists(new.astype(np.int32)), "bounds": _lists(held.astype(np.int32)), "error": pa.array(error)}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _sums(d: int):
    """(part, entry, place, total): a task's sums of components by entry, and its number of rows at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = d // PARTS
        totals, counts = np.zeros((PARTS, ENTRIES, each), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for b in batches:
            x, own = _ints(b.column("v"), d), _ints(b.column("entry"), PARTS)
            for p in range(PARTS):
                np.add.at(totals[p], own[:, p], x[:, p * each : (p + 1) * each])
                counts[p] += np.bincount(own[:, p], minlength=ENTRIES)
        part, entry = np.nonzero(counts)
        if not len(part):
            return
        place = np.arange(-1, each)
        sums = np.concatenate((counts[part, entry][:, None], totals[part, entry]), axis=1)
        wide = [np.repeat(part, each + 1), np.repeat(entry, each + 1), np.tile(place, len(part)), sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in wide], ["part", "entry", "place", "total"])

    return run


def _moved(entries: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Codebooks (part, entry, place) with each used entry replaced by floor(sum / count)."""
    part, entry, place, total = (rows.column(c).to_numpy() for c in ("part", "entry", "place", "total"))
    counts = np.zeros(entries.shape[:2], np.int64)
    at = place < 0
    counts[part[at], entry[at]] = total[at]
    out = entries.copy()
    out[part[~at], entry[~at], place[~at]] = total[~at] // counts[part[~at], entry[~at]]  # // of numpy goes down
    return out


class Coded:
    """Rows (vec_id, label, entry, error) and the final codebooks as an array of (part, entry, place)."""

    def __init__(self, rows: DataFrame, codebooks: np.ndarray):
        self.rows, self.codebooks = rows, codebooks

    @property
    def digest(self) -> str:
        """Hex SHA-256 of all components in order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> Coded:
    """Train codebooks on all rows and code them.

    Rows whose vector is null, empty or holds a null or non-finite component are dropped; so are those with a
    component that is wider than ``widest`` (a hundred thousand and more in 64 places: its error may be beyond a
    long), with a length that PARTS does not divide, or with another length than that of the first row by vec_id. The codebooks start as the parts of the ENTRIES rows
    with the smallest vec_id (nulls last, ties by the components), of fewer rows as all of them; equal entries stay
    equal and the lower index is taken. Rows that share a vec_id are rows of their own. An empty table gives none,
    with codebooks without entries. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(f"`{embedding}`"), lambda x: F.floor(x.cast("double") * SCALE))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.size("raw")))
    fine = F.size("raw") > 0
    fine &= F.size("raw") % PARTS == 0
    fine &= ~F.exists("raw", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * SCALE >= most))
    base = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("raw"), whole.alias("v"))
    base = base.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", F.col("v").cast("array<int>").alias("v"))
    head = base.orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = head.select(F.size("v").alias("d")).first()
    if first is None:
        return Coded(base.select("vec_id", "label", F.array().cast("array<int>").alias("entry"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64))
    d = first["d"]
    same = base.where(F.size("v") == d)
    start = np.array([r["v"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()], np.int64)
    entries = np.ascontiguousarray(start.reshape(len(start), PARTS, d // PARTS).transpose(1, 0, 2))
    groups = [group_of(e) for e in entries]
    schema = f"vec_id long, label {same.schema['label'].dataType.simpleString()}, v array<int>, entry array<int>, bounds array<int>, error long"
    rows = same.select("*", F.lit(None).cast("array<int>").alias("entry"), F.lit(None).cast("array<int>").alias("bounds"))
    folder, before, held = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}", None, None
    for k in range(rounds + 1):
        books = [Codebook(e, g, None if before is None else before[p]) for p, (e, g) in enumerate(zip(entries, groups, strict=True))]
        # written once: the sums and the next round read the same rows, whatever executors are lost
        rows.mapInArrow(_assign(books, d), schema).write.parquet(f"{folder}/{k}")
        rows = spark.read.schema(schema).parquet(f"{folder}/{k}")
        if held is not None:
            remove(spark, held)
        held = f"{folder}/{k}"
        if k < rounds:
            sums = rows.select("v", "entry").mapInArrow(_sums(d), "part long, entry long, place long, total long")
            before, entries = entries, _moved(entries, sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow())
    return Coded(rows.select("vec_id", "label", "entry", "error"), entries)


def label_errors(coded: Coded) -> DataFrame:
    """The coded rows with label_error, the sum of the errors of all rows with an equal label (nulls are equal)."""
    by_label = small_side(coded.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
