"""Lattice hashing against all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import embed, queries


def _truth(ids, x, least=0.95):
    """(links, least id of the group) of each row, by all pairs."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            break
        label = new
    lowest = {g: min((i for i, k in zip(ids, label, strict=True) if k == g and i is not None), default=None) for g in set(label)}
    return near.sum(axis=1) - 1, [lowest[g] for g in label]


def _frame(spark, ids, x, kind="float"):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("cap", [5, 8192])
def test_links_and_groups_are_those_of_all_pairs(spark, cap):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(12, 32)) * 0.12 for c in rng.normal(size=(30, 32))])
    x = np.concatenate([x, x[:3], rng.normal(size=(40, 32))]).astype(np.float32)
    ids = list(range(len(x)))
    links, lowest = _truth(ids, x.astype(float))
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, []), (905, [float("inf")] * 32), (906, [1.0] * 31)], "vec_id long, embedding array<float>")
    df = _frame(spark, ids, x).union(odd).withColumn("node", F.lit("x")).withColumn("g", F.lit(0)).withColumn("key", F.lit(1))
    got = {r["vec_id"]: r for r in embed.near_duplicates(df, cap=cap).collect()}
    assert len(got) == len(x) + 7
    found = np.array([got[k]["n_links"] for k in ids])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert np.mean([got[k]["component_id"] == lowest[k] for k in ids]) > 0.98
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(900, 907))


@pytest.mark.parametrize("cap", [3, 8192])
def test_repeated_and_missing_ids(spark, cap):
    rng = np.random.default_rng(6)
    a, b, c = rng.normal(size=(3, 64))
    x = np.stack([a, a * 1.01, b, a * 2 + 0.01, b * 1.5, c, c + 1e-3, a])
    ids = [1, 2, 5, 5, 6, None, None, 1]
    links, lowest = _truth(ids, x)
    got = embed.near_duplicates(_frame(spark, ids, x, "double"), cap=cap).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == sorted((i or 0, n, g or 0) for i, n, g in zip(ids, links.tolist(), lowest, strict=True))


def test_the_table_against_all_pairs(spark):
    got = {r["vec_id"]: r for r in queries.op9_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    links, lowest = _truth([i for i, _ in rows], np.array([v for _, v in rows], float))
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i, _ in rows] == links.tolist() and [got[i]["component_id"] for i, _ in rows] == lowest
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i, _ in rows)


def test_recall_near_the_bound(spark):
    """Pairs at cosines of 0.95 to 0.96: nine in ten or more are found, and none below the bound."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.94, 0.96, size=(600, 1))
    x = np.concatenate((a, cosine * a + np.sqrt(1 - cosine**2) * b))
    links, _ = _truth(list(range(1200)), x)
    found = np.array([r["n_links"] for r in sorted(embed.near_duplicates(_frame(spark, range(1200), x, "double")).collect(), key=lambda r: r["vec_id"])])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() > 0


def test_signs_and_decoding():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 8)) * 2
    points = embed.decode_e8(x)
    around = points[:, None, :] + embed._roots()[None]
    assert (((x - points) ** 2).sum(axis=1) <= ((x[:, None] - around) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert 18 <= embed._reach(0.95) <= 22


def test_empty_table(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
