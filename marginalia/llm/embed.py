"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random to LATTICES times 8 dimensions, once for each of TABLES tables, scaled,
and each 8 dimensions are decoded to the nearest point of the E8 lattice; the points together are the vector's
cell. A vector is filed under its own cell and asks in the PROBES nearest of the neighbouring cells, one lattice
step away, as well.

Only keys are dealt by cell at first: (cell, node) with 64 signs of further random projections. Rows that
meet no row there whose signs could belong to a cosine of the bound are done. Vectors are sent to the cells
that are left and compared in double precision. Equal vectors are one node with a count; a cell of over CAP
rows is cut into chunks that meet pair by pair, so no task holds a hot cell whole and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import by_group, checkpoint, components, hot_keys, hot_pairs, local_components

LEAST_COSINE = 0.95
#: Recall of a pair at a cosine of just 0.95 is 0.95 with these, and above 0.99 from 0.97 on (random pairs in 64 dimensions).
TABLES, LATTICES, PROBES, SCALE, CAP = 6, 2, 1, 0.48, 8192
#: Deviations by which the unlike signs of a pair at the bound may exceed their mean: one pair in 10^8 is lost.
DEVIATIONS = 5.6
#: Tables whose own cells a key tells (16 bits each), so that pairs that met there are not asked for again.
TOLD = 4
SEED = 20_240_229


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        k = np.abs(off).argmax(axis=1)
        near[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: the nearer of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit key of lattice points (they are halves of integers)."""
    h = np.full(len(points), (table + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for x in (2 * points).astype(np.int64).T.astype(np.uint64):
        h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@cache
def _projections(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random projections of d dimensions: onto the lattices (side by side), and for the signs."""
    rng = np.random.default_rng(SEED + d)
    return rng.normal(size=(d, TABLES * LATTICES * 8)) * SCALE, rng.normal(size=(d, 64))


def cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own cells: rows x tables, probed cells: rows x tables x probes) of unit vectors."""
    y = vectors @ _projections(vectors.shape[1])[0]
    n, row = len(y), np.arange(len(y))
    own, near = [], []
    for t in range(TABLES):
        parts = [y[:, (t * LATTICES + k) * 8 : (t * LATTICES + k + 1) * 8] for k in range(LATTICES)]
        points = [decode_e8(x) for x in parts]
        gains = np.concatenate([(x - p) @ _roots().T for x, p in zip(parts, points, strict=True)], axis=1)
        whole = np.concatenate(points, axis=1)
        own.append(_cell(whole, t))
        probed = []
        for step in np.argpartition(-gains, PROBES - 1, axis=1)[:, :PROBES].T:
            moved = whole.copy().reshape(n, LATTICES, 8)
            moved[row, step // len(_roots())] += _roots()[step % len(_roots())]
            probed.append(_cell(moved.reshape(n, -1), t))
        near.append(np.stack(probed, axis=1))
    return np.stack(own, axis=1), np.stack(near, axis=1)


def _signs(vectors: np.ndarray) -> np.ndarray:
    return np.packbits(vectors @ _projections(vectors.shape[1])[1] > 0, axis=1).view(np.uint64).ravel()


def _reach(least: float) -> int:
    """Most unlike signs of a pair at the bound."""
    p = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(64 * p + DEVIATIONS * np.sqrt(64 * p * (1 - p))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge vectors leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE, cap: int = CAP) -> DataFrame:
    """(vec_id, n_links, component_id) of every row, whatever its labels.

    n_links counts the other rows linked directly (cosine >= least and found by a table), component_id
    is the smallest vec_id reachable. Null vectors and those that are empty, zero or hold a null or
    non-finite component link with nothing. Vectors of different lengths do not link. Every row is a
    vector of its own, also where rows share a vec_id: equal vectors are links of each other, and each
    row has the links and the component of its own vector. A row without a vec_id links like any other
    and has the component of its group, null if no row of it has an id. An empty table gives none;
    other columns are not read.
    """
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(F.col("v").isNotNull() & fine, F.lit(False))
    key = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(3), "v"))
    keyed = base.select("vec_id", "v", F.when(fine, key).alias("key"))
    # nodes have numbers of their own: what two unlike vectors share by chance, an id, joins nothing
    unlike = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    nodes = checkpoint(unlike.withColumn("node", F.monotonically_increasing_id()))
    spread = checkpoint(nodes.select("node", "v", F.size("v").alias("d")).mapInArrow(_file, "g long, row long, signs long, told long"))
    hot = hot_keys(spread, "g", cap)
    cold = by_group(spread.join(hot, "g", "left_anti"), "g", _meeting(_reach(least)), "g long, row long")
    met = checkpoint(cold.union(spread.join(hot, "g", "left_semi").select("g", "row")))  # hot cells are not searched twice
    met = met.select("g", F.shiftright("row", 4).alias("node"), (F.col("row") % 2 == 1).alias("home"), F.shiftright(F.col("row") % 16, 1).cast("int").alias("t"))
    asked = hot_pairs(met, "g", "node", cap).join(nodes.select("node", "copies", "v"), "node")
    found = checkpoint(by_group(asked.select("g", "node", "copies", "home", "t", "v", "chunk", "lo", "hi"), "g", _compare(least), "node long, links long, a long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("a is not null").select(F.col("node").alias("b"), "a"))
    per_node = nodes.select("key", "node", "lowest", "copies").join(counts, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("key", "lowest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("class"))
    first = per_node.groupBy("class").agg(F.min("lowest").alias("component"))
    per_key = per_node.join(first, "class").select("key", "links", "component", F.lit(True).alias("linked"))
    out = keyed.select("vec_id", "key").join(per_key, "key", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), d)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node with table and whether it is at home, signs, own cells) of distinct vectors, each under its own
    and the probed cells of every table."""
    for batch in batches:
        sizes = batch.column(2).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == d))
            x = _unit(_matrix(part.column(1), d))
            own, near = cells(x)
            keys = np.concatenate((own[:, :, None], near), axis=2)
            n, tables, each = keys.shape
            home = np.zeros((tables, each), np.int64)
            home[:, 0] = 1
            rows = (part.column(0).to_numpy()[:, None, None] << 4) + (np.arange(tables)[:, None] << 1) + home
            told = sum((own[:, t].view(np.uint64) >> np.uint64(48)) << np.uint64(16 * t) for t in range(TOLD)).view(np.int64)
            wide = lambda a, k=tables * each: np.repeat(a, k)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rows.ravel()), pa.array(wide(_signs(x).view(np.int64))), pa.array(wide(told))], ["g", "row", "signs", "told"])


def _runs(g: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of the runs of two and more."""
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    long = np.flatnonzero(np.diff(cuts) > 1)
    return zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True)


def _meeting(reach: int):
    """For runs of whole groups: the rows that may have a link there that no earlier table's own cells have shown."""

    def run(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g, row, signs, told = (part.column(c).to_numpy() for c in ("g", "row", "signs", "told"))
        signs, told = signs.view(np.uint64), told.view(np.uint64)
        kept = []
        for s, e in _runs(g):
            table = int(row[s] >> 1) % 8
            homes = s + np.flatnonzero(row[s:e] & 1)
            met = np.zeros(e - s, bool)
            for k in range(0, len(homes), 256):
                h = homes[k : k + 256]
                close = np.bitwise_count(signs[h][:, None] ^ signs[s:e][None, :]) <= reach
                close &= (row[h] >> 4)[:, None] != (row[s:e] >> 4)[None, :]
                for t in range(min(table, TOLD)):
                    close &= ((told[h][:, None] ^ told[s:e][None, :]) >> np.uint64(16 * t)) & np.uint64(0xFFFF) != 0
                met |= close.any(axis=0)
                met[h - s] |= close.any(axis=1)
            kept.append(s + np.flatnonzero(met))
        if kept and len(at := np.concatenate(kept)):
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(row[at])], ["g", "row"])

    return run


def _compare(least: float):
    """For runs of whole groups: links of each node, each pair counted in one group only, and its smallest local node."""

    def run(part: pa.Table) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in _runs(part.column("g").to_numpy()):
            out += _group(part.slice(s, e - s), least)
        if out:
            node, links, low = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(low, mask=low == node)], ["node", "links", "a"])

    return run


def _group(part: pa.Table, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Compares the rows at home in a cell with all rows of it, block by block."""
    node, copies, home, table, chunk, lo, hi = (part.column(c).to_numpy() for c in ("node", "copies", "home", "t", "chunk", "lo", "hi"))
    lengths = np.diff(part.column("v").combine_chunks().offsets.to_numpy())
    if (lengths != lengths[0]).any():  # two lengths in one cell: each by itself
        return [x for d in np.unique(lengths).tolist() for x in _group(part.filter(pa.array(lengths == d)), least)]
    x = _unit(_matrix(part.column("v"), int(lengths[0])))
    own, near = cells(x)
    links = np.zeros(len(node), np.int64)
    every = np.arange(len(node))
    label = every  # the smallest row of the part reached so far
    homes = np.flatnonzero(home)
    for a in range(0, len(homes), 1024):
        h = homes[a : a + 1024]
        for b in range(0, len(node), 1024):
            i, j = np.nonzero(x[h] @ x[b : b + 1024].T >= least)
            i, j = h[i], j + b
            # two rows that are both at home meet in one order only; rows of one chunk meet in that chunk's own group
            keep = (node[i] != node[j]) & (~home[j] | (node[i] < node[j])) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j])) & (table[i] == table[j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            for k in range(0, len(i), 20_000):
                p, q = i[k : k + 20_000], j[k : k + 20_000]
                count = _counts_here(own[p], near[p], own[q], near[q], home[q], table[p])
                np.add.at(links, p[count], copies[q[count]])
                np.add.at(links, q[count], copies[p[count]])
            label = local_components(len(node), np.concatenate((every, i)), np.concatenate((label, j)))
    low = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, label, node)
    used = np.flatnonzero(np.bincount(label, minlength=len(node))[label] > 1)
    return [(node[used], links[used], low[label[used]])] if len(used) else []


def _counts_here(own_p: np.ndarray, near_p: np.ndarray, own_q: np.ndarray, near_q: np.ndarray, home_q: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether this cell (p is at home in it) is where the pair counts: in the first table where the two
    meet, and of two cells of one table in the one with the smaller key."""
    asks = (near_p == own_q[:, :, None]).any(axis=2)
    meet = (own_p == own_q) | asks | (near_q == own_p[:, :, None]).any(axis=2)
    row = np.arange(len(table))
    first = meet.argmax(axis=1) == table
    other = asks[row, table] & (own_q[row, table] < own_p[row, table])
    return first & (home_q | ~other)
