"""SimHash near-duplicates: 64-bit fingerprints, linked by vantage-point trees.

A tree splits a set of fingerprints at the median distance to a vantage point. Pairs across the split meet only
where the triangle bound lets them, in the overlap of both sides within the radius of the border; all other
pairs of branches are pruned. Up to ONE_TREE distinct fingerprints are one tree. Its first level is dealt to tasks: the
fingerprints are partitioned by their distance to a vantage point into shells, and a shell is queried with each
shell that a ball of the radius can reach, |d(x, v) - d(y, v)| <= 4; every such pair of shells is a tree of its own.

Beyond ONE_TREE, whole fingerprints prune too little to be one tree: distances to any vantage point crowd around
32 with a deviation of 4, so a ball of radius 4 crosses 84 % of every level. The radius is shared out first then. The
64 bits are cut into BLOCKS blocks; two fingerprints within 4 bits agree in BLOCKS - 4 of them at least. For each
choice of that many blocks, fingerprints that agree there are a shard (two million shards a choice), and each
shard is a tree over all 64 bits, cut into shells as above where it has over TREE_CAP fingerprints. Both ways find the
same links.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import by_group, checkpoint, components, hot_keys

BITS = 64
RADIUS = 4
WORDS = 4
#: similar(): words of a shingle, least similarity, bits that two texts may differ in to be looked at, blocks
#: of a fingerprint and how many of them make a tree.
SIMILAR_WORDS, SIMILARITY, REACH, SIMILAR_BLOCKS, AGREE = 5, 0.8, 12, 9, 2
#: Bins of a sketch, and how far below the least similarity its estimate may be (four deviations).
BINS, SLACK = 256, 0.1
#: similar(): each round verifies so many times more candidates of a text than the one before.
WIDEN = 4
BLOCKS = 6
LEVELS = 8
#: Rows of a shard, of near_duplicates() and of similar(), of a shell of the one tree, and of a tree's leaf.
TREE_CAP, CAP, SHELL_CAP, LEAF = 32768, 2048, 1024, 128
#: Distinct fingerprints that are one tree.
ONE_TREE = 1 << 17
#: Vantage points that are tried on two branches that overlap whole.
TRIES = 3
#: Makes the hashes of a second fingerprint out of those of the first.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Vantage points, one for each level of a block's tree; fixed pseudo-random numbers.
VANTAGE = [int(xxhash.xxh64_intdigest(f"vantage {k}")) for k in range(LEVELS + 1)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the whole text; 0 for a null text or one without words."""
    return _majority(shingles(text, words))


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shards(nodes: DataFrame, agree: int, blocks: int, first: int = 0) -> DataFrame:
    """One row for each fingerprint and choice of ``agree`` blocks: its shard, that of those that are alike there.

    Bits of a block are alike where the distances to LEVELS vantage points within it are.
    Two fingerprints within ``radius`` bits agree in ``blocks - radius`` blocks at least.
    """
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    leaves = []
    for b in range(blocks):
        mask = sum(1 << i for i in range(edges[b], edges[b + 1]))
        inside = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        leaves.append(F.xxhash64(F.lit(b), *[F.bit_count(inside.bitwiseXOR(F.lit(_signed(v & mask)))) for v in VANTAGE[:LEVELS]]).alias(f"leaf{b}"))
    trees = [F.xxhash64(F.lit(k), *[f"leaf{b}" for b in chosen]) for k, chosen in enumerate(combinations(range(blocks), agree), first)]
    return nodes.select("node", "fp", *leaves).select("node", "fp", F.explode(F.array(*trees)).alias("g"))


class _Counters(AccumulatorParam):
    """Sums of counters that tasks send."""

    def zero(self, value: Counter) -> Counter:
        return Counter()

    def addInPlace(self, value1: Counter, value2: Counter) -> Counter:  # noqa: N802
        value1.update(value2)
        return value1


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cap: int = TREE_CAP, seen: Accumulator | None = None) -> DataFrame:
    """Spanning edges (a, b) of the graph that joins distinct fingerprints within ``radius`` bits.

    nodes: (node, fp), one row for each distinct fingerprint. No pair list is made: each shard gives
    the edges from its nodes to the smallest node that they reach inside the shard. seen: adds what ``tree_join``
    counts in all shards.
    """
    if nodes.count() <= ONE_TREE:
        split = _split(nodes.select("node", "fp", F.lit(0).cast("long").alias("g")), radius, min(cap, SHELL_CAP))
    else:
        split = _split(_shards(nodes, blocks - radius, blocks), radius, cap)

    def run(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g, node, fp = (part.column(c).to_numpy() for c in ("g", "node", "fp"))
        fp = fp.view(np.uint64)
        out_a, out_b = [], []
        counted: Counter = Counter()
        for s, e in _groups(g):
            root = tree_join(fp[s:e], radius, seen=counted)
            low = np.full(e - s, np.iinfo(np.int64).max)
            np.minimum.at(low, root, node[s:e])
            other = low[root] != node[s:e]
            out_a.append(node[s:e][other])
            out_b.append(low[root][other])
        if seen is not None:
            seen.add(counted)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return by_group(split, "g", run, "a long, b long")


def tree_join(fp: np.ndarray, radius: int, leaf: int = LEAF, seen: Counter | None = None) -> np.ndarray:
    """A root for each fingerprint, the same for those that links of ``radius`` bits or fewer join.

    The vantage-point tree is searched with itself: a branch with itself, and with another one as far as
    their overlap goes. ``seen`` counts pairs: compared, pruned (by the triangle bound) and met in an overlap.
    """
    parent = np.arange(len(fp))
    seen = Counter() if seen is None else seen

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        seen["compared"] += len(a) * len(b)
        i, j = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
        p, q = parent[a[i]], parent[b[j]]
        apart = p != q
        if apart.any():
            for x, y in np.unique(np.stack((p[apart], q[apart])), axis=1).T.tolist():
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
            for own in (a, b):
                while (parent[parent[own]] != parent[own]).any():
                    parent[own] = parent[parent[own]]

    work: list[tuple[np.ndarray, np.ndarray | None, int]] = [(np.arange(len(fp)), None, 0)]
    while work:
        a, b, tries = work.pop()
        same = b is None
        other = a if same else b
        if not len(a) or not len(other):
            continue
        first = parent[a[0]]
        if (parent[a] == first).all() and (same or (parent[other] == first).all()):
            continue  # joined already
        if len(a) * len(other) <= leaf * leaf:
            compare(a, other)
            continue
        vantage = fp[a[(len(a) // 2 + tries * 7919) % len(a)]]
        near_a, near_b = (np.bitwise_count(fp[x] ^ vantage).astype(np.int64) for x in (a, other))
        both = near_a if same else np.concatenate((near_a, near_b))
        border = np.median(both)
        border = int(border) if both.min() < both.max() and border < both.max() else int(both.max()) - 1
        in_a, in_b = near_a <= border, near_b <= border
        if tries == TRIES or in_a.all() and in_b.all() or not (in_a.any() or in_b.any()):  # nothing to split
            for k in range(0, len(a), leaf):
                for h in range(k if same else 0, len(other), leaf):
                    compare(a[k : k + leaf], other[h : h + leaf])
            continue
        # a pair across the border lies within the radius of it on both sides
        for side_a, side_b, at_a, at_b in [(in_a, ~in_b, near_a > border - radius, near_b <= border + radius), (~in_a, in_b, near_a <= border + radius, near_b > border - radius)][: 1 if same else 2]:
            met = int((side_a & at_a).sum()) * int((side_b & at_b).sum())
            seen["overlap"] += met
            seen["pruned"] += int(side_a.sum()) * int(side_b.sum()) - met
            if met:  # if the overlap is all there is, another vantage point may tell more
                work.append((a[side_a & at_a], other[side_b & at_b], tries + 1 if met == len(a) * len(other) else 0))
        # the sides themselves come first: what they join need not be looked for across
        work.append((a[in_a], None if same else other[in_b], 0))
        work.append((a[~in_a], None if same else other[~in_b], 0))
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _groups(g: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of the runs of two and more."""
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e - s > 1:
            yield s, e


def _split(rows: DataFrame, radius: int, cap: int) -> DataFrame:
    """Shards of over ``cap`` rows cut by their distance to a vantage point; fingerprints within ``radius`` still meet."""
    sizes = hot_keys(rows, "g", cap)
    shell = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(VANTAGE[LEVELS])))).cast("int")
    return (
        rows.join(sizes, "g", "left")
        .withColumn("_k", F.coalesce(F.ceil(F.col("_n") / (4.0 * cap)).cast("int"), F.lit(0)))
        .withColumn("_home", F.when(F.col("_k") > 0, shell * F.col("_k") + F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")).otherwise(0))
        .withColumn("_shell", F.when(F.col("_k") > 0, shell).otherwise(0))
        # the cells of every shell that the ball around the fingerprint can reach
        .withColumn("_cell", F.explode(F.when(F.col("_k") > 0, F.sequence(F.greatest(F.lit(0), F.col("_shell") - radius) * F.col("_k"), (F.least(F.lit(BITS), F.col("_shell") + radius) + 1) * F.col("_k") - 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("g", F.when(F.col("_k") > 0, F.xxhash64("g", F.least("_home", "_cell"), F.greatest("_home", "_cell"))).otherwise(F.col("g")))
        .select("g", "node", "fp")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, cap: int = TREE_CAP, seen: Accumulator | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable.

    Null and wordless texts have fingerprint 0 and link like any other. The fingerprints are what is
    linked: rows that share a doc_id are joined by their fingerprints only. Rows with a null doc_id link
    too; a group without any doc_id has a null component. Repeated rows stay repeated; other columns are
    not read. An empty table gives an empty result. seen: an accumulator (``counters``) of what the trees did.
    """
    hashed = checkpoint(fingerprints(docs, doc_id, text, words))
    nodes = checkpoint(hashed.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, blocks, cap, seen))
    classes = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lowest", F.coalesce("component", "fp").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("lowest").alias("component_id"))
    return hashed.join(classes.join(lowest, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def counters(spark: SparkSession) -> Accumulator:
    """For ``seen``: how many pairs the trees compared, pruned by the triangle bound, and met in an overlap."""
    return spark.sparkContext.accumulator(Counter(), _Counters())


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for the least hash of each of BINS bins, 0 for an empty one."""
    if not len(hashes):
        return bytes(BINS)
    h = np.sort(hashes)
    first = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(h, first)
    least = h[np.minimum(at, len(h) - 1)]
    there = (at < len(h)) & (least >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
    return np.where(there, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def _estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch to others; two texts without words are alike."""
    filled = ((one > 0) | (others > 0)).sum(axis=1)
    same = ((one == others) & (one > 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def _forest(fp: np.ndarray, sketches: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """Greatest spanning forest (Prim) of the pairs within ``radius`` bits, by estimated similarity.

    Cut at an estimate, such a forest has the components of the graph of estimates. Where verification
    drops one of its edges, ``_between`` finds what else may join the parts.
    """
    left = np.arange(1, len(fp))
    best, parent = np.zeros(len(fp)), np.zeros(len(fp), np.int64)
    at, edges = 0, []
    while len(left):
        near = left[np.bitwise_count(fp[left] ^ fp[at]) <= radius]
        if len(near):
            found = _estimates(sketches[at], sketches[near])
            better = found > best[near]
            best[near[better]], parent[near[better]] = found[better], at
        k = int(best[left].argmax())
        at = int(left[k])
        if best[at] >= least:
            edges.append((at, int(parent[at])))
        left = np.delete(left, k)
    return edges


def _between(fp: np.ndarray, sketches: np.ndarray, node: np.ndarray, parts: np.ndarray, failed: list, radius: int, least: float, most: int) -> list[tuple[int, int]]:
    """Pairs of different parts that were not verified yet, estimated at ``least`` or more and within ``radius`` bits: the
    ``most`` likeliest of each row with the rows after it."""
    edges = []
    for k in range(len(fp) - 1):
        near = k + 1 + np.flatnonzero((np.bitwise_count(fp[k + 1 :] ^ fp[k]) <= radius) & (parts[k + 1 :] != parts[k]))
        if len(near) and failed[k] is not None:
            near = near[~np.isin(node[near], failed[k])]
        if not len(near):
            continue
        found = _estimates(sketches[k], sketches[near])
        near, found = near[found >= least], found[found >= least]
        edges += [(k, int(j)) for j in near[np.argsort(-found, kind="stable")[:most]]]
    return edges


def _joining(radius: int, least: float, most: int):
    """For by_group: the edges (g, a, b) of ``_between`` of each shard."""

    def run(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g, node, fp, parts = (part.column(c).to_numpy() for c in ("g", "node", "fp", "part"))
        fp = fp.view(np.uint64)
        sketches, failed = part.column("sketch").combine_chunks(), part.column("failed").combine_chunks()
        edges: list[tuple[int, int, int]] = []
        for s, e in _groups(g):
            own = np.frombuffer(b"".join(sketches.slice(s, e - s).to_pylist()), np.uint8).reshape(-1, BINS)
            known = [failed[k].values.to_numpy() if failed[k].is_valid else None for k in range(s, e)]
            edges += [(int(g[s]), int(node[s + a]), int(node[s + b])) for a, b in _between(fp[s:e], own, node[s:e], parts[s:e], known, radius, least, most)]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["g", "a", "b"])

    return run


def _parts(found: DataFrame, side: str) -> DataFrame:
    return found.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, reach: int = REACH, cap: int = CAP) -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts linked by a Jaccard similarity of their shingle
    sets of ``similarity`` or more; component_id is the smallest doc_id of the group.

    Candidates come from shards of two fingerprints that agree in AGREE blocks: pairs there that differ in ``reach`` bits
    or fewer. No tree is searched: a radius of 12 bits prunes nothing, and a shard has few texts. In each shard a fixed-size sketch orders them into
    a greatest spanning forest; its edges are verified on the whole shingle sets. Where one fails, the shard's
    other candidates between the parts are verified too, WIDEN times as many a row in each round, until no
    candidate that was not verified joins two parts. Pairs close to
    0.8 can be missed: one in twenty or so at just 0.8 by a binomial estimate; 3 of 48 pairs at sf0.1.
    Texts without words (null, empty) form one group. A null doc_id gives a null component unless its
    group has another id. Repeated rows stay repeated; an empty table gives an empty result.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key)

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches = [], []
            for x in batch.column(2):
                h = np.unique(shingles(x.as_py(), words))  # as the similarity: repeats do not count
                fps.append((_majority(h), _majority((h ^ (h >> np.uint64(29))) * MIX)) if len(h) else (0, 0))
                sketches.append(sketch(h))
            both = np.array(fps, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both[0]), pa.array(both[1]), pa.array(sketches, pa.binary())], ["doc_id", "node", "fp0", "fp1", "sketch"])

    hashed = checkpoint(base.select("doc_id", "node", "text").mapInArrow(hashing, "doc_id long, node long, fp0 long, fp1 long, sketch binary"))
    nodes = checkpoint(hashed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp0", "fp1", "sketch")]))
    trees = comb(SIMILAR_BLOCKS, AGREE)
    leaves = [_shards(nodes.select("node", F.col(f"fp{k}").alias("fp")), AGREE, SIMILAR_BLOCKS, k * trees) for k in range(2)]

    def meeting(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g, fp = part.column("g").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
        met = np.zeros(len(g), bool)
        for s, e in _groups(g):
            for k in range(s, e - 1):
                close = np.bitwise_count(fp[k + 1 : e] ^ fp[k]) <= reach
                if close.any():
                    met[k] = True
                    met[k + 1 : e] |= close
        yield from part.filter(pa.array(met)).to_batches()

    met = checkpoint(by_group(_split(leaves[0].union(leaves[1]), reach, cap), "g", meeting, "g long, node long, fp long"))

    def spanning(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g, node, fp = (part.column(c).to_numpy() for c in ("g", "node", "fp"))
        fp = fp.view(np.uint64)
        sketches = part.column("sketch").combine_chunks()
        edges: list[tuple[int, int, int]] = []
        for s, e in _groups(g):
            own = np.frombuffer(b"".join(sketches.slice(s, e - s).to_pylist()), np.uint8).reshape(-1, BINS)
            edges += [(int(g[s]), int(node[s + a]), int(node[s + b])) for a, b in _forest(fp[s:e], own, reach, similarity - SLACK)]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["g", "a", "b"])

    ordered = lambda df: df.select("g", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rows = met.join(nodes.select("node", "sketch"), "node").select("g", "node", "fp", "sketch")
    asking = checkpoint(ordered(by_group(rows, "g", spanning, "g long, a long, b long")))
    asked = asking.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.unique(shingles(batch.column(1)[k].as_py(), words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([own], pa.list_(pa.int64()))], ["node", "own"])

    # one row of each text leaves a task, however many copies there are (a semi join would be moved below the aggregation)
    texts = base.select("node", "text").dropDuplicates(["node"]).join(asked, "node").select("node", "text")
    known = checkpoint(texts.mapInArrow(sets, "node long, own array<long>"))
    side = lambda c: known.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    total = F.size("own_a") + F.size("own_b") - shared
    good = (total == 0) | (shared >= similarity * total)
    verified = lambda asking: checkpoint(asking.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", good.alias("good")))

    tested = verified(asking)
    found = components(tested.where("good"))
    # a shard is settled if every edge of its forest lies inside one part
    failing = tested.where(~F.col("good")).join(_parts(found, "a"), "a", "left").join(_parts(found, "b"), "b", "left")
    failing = failing.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    asking, most = checkpoint(asking.join(failing, ["a", "b"], "left_semi").select("g").distinct()), 1
    while not asking.isEmpty():
        most *= WIDEN
        bad = tested.where(~F.col("good"))
        bad = bad.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        bad = bad.groupBy("e.node").agg(F.collect_list("e.other").alias("failed"))
        parts = found.select("node", F.col("component").alias("part"))
        rows = met.join(asking.select("g").distinct(), "g", "left_semi").join(nodes.select("node", "sketch"), "node").join(parts, "node", "left").join(bad, "node", "left")
        rows = rows.select("g", "node", "fp", "sketch", F.coalesce("part", "node").alias("part"), "failed")
        asking = checkpoint(ordered(by_group(rows, "g", _joining(reach, similarity - SLACK, most), "g long, a long, b long")))
        if asking.isEmpty():
            break
        tested = checkpoint(tested.union(verified(asking)))
        found = components(tested.where("good"))
    classes = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(lowest, "class").select("node", "component_id")
    return hashed.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
