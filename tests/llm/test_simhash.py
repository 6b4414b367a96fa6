"""Fingerprints and their links against plain Python and all pairs; what the trees prune."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import queries, simhash
from marginalia.llm.common import components

DATA = "/root/testdata/sf0.01"


def _fingerprint(text):
    """By the definition, a shingle at a time."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def _labels(fp, radius=4):
    """The first row of each one's group, by all pairs."""
    u = np.array(fp, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def test_the_query_matches_plain_fingerprints_and_all_pairs(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()
    got = {r["doc_id"]: r for r in queries.op6_simhash(spark, DATA).collect()}
    fp = [_fingerprint(t) for _, t in rows]
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{x:016x}" for x in fp]
    assert [got[i]["component_id"] for i, _ in rows] == [rows[k][0] for k in _labels(fp)]


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.1"])
@pytest.mark.parametrize("one", [simhash.ONE_TREE, 0])
def test_trees_split_prune_and_overlap_on_the_tables(spark, monkeypatch, data, one):
    """What the operator itself does on the given tables, in one tree and in shards of agreeing blocks: the same links as all pairs."""
    monkeypatch.setattr(simhash, "ONE_TREE", one)
    seen = simhash.counters(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, seen=seen).collect()}
    if one:
        assert min(seen.value[k] for k in ("compared", "pruned", "overlap")) > 0
    ids = sorted(got)
    fp = np.array([got[i][0] for i in ids], np.uint64)
    label = np.arange(len(fp))  # an id's place
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 4) for x in fp]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert [got[i][1] for i in ids] == [ids[k] for k in label]


def _dense(n=150, seed=1):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for _ in range(n)} | {int(x) for x in rng.integers(1 << 62, size=n)}
    return sorted(fps)


@pytest.mark.parametrize("cap", [4, 32768])
def test_dense_shards_are_split_without_loss(spark, cap):
    fps = _dense(60)
    nodes = spark.createDataFrame([(k, simhash._signed(x)) for k, x in enumerate(fps)], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, cap=cap)).collect()}
    label = _labels(fps)
    assert all(got.get(k, k) == label[k] for k in range(len(fps)))


@pytest.mark.parametrize("leaf", [1, 4, 128])
@pytest.mark.parametrize("seed", range(4))
def test_the_tree_joins_what_all_pairs_join(leaf, seed):
    fps = _dense(80, seed)
    root = simhash.tree_join(np.array(fps, np.uint64), 4, leaf)
    label = _labels(fps)
    assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(len(fps)) for j in range(i))


def test_the_tree_prunes_and_queries_overlaps(spark):
    """On a shard of the table's own kind, as the query meets them, and on a dense group."""
    fps = np.array(_dense(2000), np.uint64)
    seen = Counter()
    simhash.tree_join(fps, 4, seen=seen)
    pairs = len(fps) * (len(fps) - 1) // 2
    assert seen["pruned"] > 0.5 * pairs and seen["overlap"] > 0 and seen["compared"] < 0.7 * pairs
    # every pair of texts in a shard agrees in the blocks of its choice
    rows = [(k, simhash._signed(int(x))) for k, x in enumerate(fps[:50])]
    shards = simhash._shards(spark.createDataFrame(rows, "node long, fp long"), 2, 6)
    assert shards.count() == 15 * len(rows)


def test_one_distance_cannot_be_split():
    fps = np.array([(1 << k) for k in range(64)] + [(1 << k) | (1 << 63) for k in range(60)], np.uint64)
    assert len(set(simhash.tree_join(fps, 4, leaf=2).tolist())) == 1
    assert len(set(simhash.tree_join(fps[:64], 1, leaf=2).tolist())) == 64


def test_repeated_and_missing_ids_and_odd_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(7, a), (3, a), (3, b), (5, b), (None, c), (None, c), (9, None), (8, ""), (8, " \n"), (1, "one two"), (2, "One  two"), (4, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("node", F.lit(2)).withColumn("g", F.lit("g"))
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (5, 3), (0, None), (0, None), (9, 8), (8, 8), (8, 8), (1, 1), (2, 1), (4, 4)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
