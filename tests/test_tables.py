import datetime
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators.binning import TableBinner, merge_intervals, private_tree
from marginalia.operators.marginals import check_codes, count_cells, dense_marginal
from marginalia.pipeline import GraphicalGenerator, Pipeline
from marginalia.plans.privacy import Noise
from marginalia.sources.tables import synthetic_codes
from marginalia.types import Domain

DOMAIN = {"i": {"lower": 0, "upper": 100}, "n": {"lower": 0, "upper": 1}, "f": {"lower": 0, "upper": 1}, "c": {"categories": ["A", "B", "C"]}, "t": {"lower": datetime.datetime(2023, 1, 1), "upper": datetime.datetime(2026, 1, 1)}}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(600).select(
        F.pmod(F.xxhash64("id"), F.lit(100)).alias("i"), (F.pmod(F.hash("id"), F.lit(997)) / 997.0).alias("f"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
        F.timestamp_micros(F.lit(1672531200000000) + F.col("id") * 86400000000).cast("timestamp_ntz").alias("t"), F.make_dt_interval(F.lit(0), F.col("id").cast("int") % 100).alias("d"), (F.col("id") % 2 == 0).alias("b"),
        F.lit("x").alias("s"), F.when(F.col("id") % 2 == 0, F.lit(0.5) * (F.col("id") % 3)).alias("n"),
    )


@pytest.mark.parametrize("kind", ["uniform", "priv-tree"])
@pytest.mark.parametrize("eps", [None, 10.0])
def test_binner_round_trip(spark, mixed, kind, eps):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        b = TableBinner(kind, 10, eps, DOMAIN, {"f": [(0.2, 0.4), (0.3, 0.5)]}, seed=1).fit(mixed.where("f < 0.2 or f > 0.5"))
    coded = b.transform(mixed.where("f < 0.2 or f > 0.5").withColumn("_row_id", F.monotonically_increasing_id()), keep=("_row_id",)).persist()
    check_codes(coded, b.codes)
    back = b.inverse(coded)
    assert [f.dataType for f in back.schema.fields[1:]] == [f.dataType for f in mixed.schema.fields]
    again = b.transform(back)
    same = ["i", "f", "c", "b"]
    assert coded.select("_row_id", *same).exceptAll(b.transform(back, keep=("_row_id",)).select("_row_id", *same)).count() <= coded.count() * 0.1
    assert back.where("f > 0.2000001 and f < 0.4999999").count() == 0
    assert back.where("n is null").count() == coded.where(f"`{b.flags['n']}` = 1").count() > 0
    assert again.count() == coded.count() and b.spent <= (eps or 0) + 1e-9
    loaded = TableBinner.from_json(b.to_json())
    assert loaded.transform(mixed).exceptAll(b.transform(mixed)).count() == 0


def test_intervals_merge_and_tree_splits_where_rows_are():
    assert merge_intervals([(3, 5), (0, 1), (4, 6)]) == [(0, 1), (3, 6)]
    edges = private_tree([100] * 8 + [0] * 56, 0.0, 64.0, 8, None, Noise(0))
    assert sum(e <= 8 for e in edges) > sum(e > 8 for e in edges)


def test_counts_match_group_by(spark):
    d = Domain.of({"x": 5, "y": 3, "z": 4})
    df = synthetic_codes(spark, d, 2000, 1).persist()
    found = count_cells(df, [("x", "y"), ("z",)], d)
    for r in df.groupBy("x", "y").count().collect():
        assert found["x", "y"].values[r["x"], r["y"]] == r["count"]
    assert found["z",].sum() == 2000 and dense_marginal(df.where("x = 1"), ["x", "z"], d).count() == 20


def test_codes_are_checked(spark):
    d = Domain.of({"x": 2})
    for sql in ("SELECT 2 AS x", "SELECT -1 AS x", "SELECT CAST(NULL AS INT) AS x", "SELECT 0.5 AS x", "SELECT 1 AS y"):
        with pytest.raises(ValueError):
            check_codes(spark.sql(sql), d)


@pytest.mark.parametrize("strategy", ["mst", "aim", "priv-bayes"])
def test_noise_free_model_has_the_data_marginals(spark, strategy):
    d = Domain.of({"x": 3, "y": 4, "z": 2})
    df = spark.range(900).selectExpr("cast(id % 3 as int) x", "cast((id % 3 + id % 2) as int) y", "cast(id % 2 as int) z").persist()
    g = GraphicalGenerator(strategy, epsilon=None, iters=500, compress=False, **({"rounds": 4} if strategy == "aim" else {})).set_domain(d)
    with pytest.raises(ValueError, match="not trained"):
        g.generate(spark, 10)
    g.fit(df, marginals_only=True)
    assert g.state == "pretrained"
    g.fit(df)
    assert g.state == "trained"
    for m in g.measurements:
        assert np.abs(g.model.project(m.clique).datavector() - m.y).max() < 2
    out = g.generate(spark, 300, method="round")
    assert out.count() == 300
    again = GraphicalGenerator.from_json(g.to_json())
    assert again.generate(spark, 50, seed=4).exceptAll(g.generate(spark, 50, seed=4)).count() == 0


def test_domain_must_be_given(spark):
    with pytest.raises(ValueError, match="Domain must be provided"):
        GraphicalGenerator("mst").fit(spark.range(3))


def test_pipeline_keeps_schema_conditions_and_zeros(spark, mixed, tmp_path):
    t = mixed.drop("d")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p = Pipeline("mst", epsilon=10, proc_epsilon=0.5, n_bins=8, iters=20, seed=2).fit(t, DOMAIN, {"c": ["B"]})
    out = p.generate(spark, 200, seed=1)
    assert out.schema.names == t.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in t.schema]
    assert out.where("c = 'B' or i < 0 or i > 100 or s <> 'x'").count() == 0 and p.spent_epsilon <= 10.5 + 1e-6
    given = t.select("b", "i").limit(40)
    made = p.generate(spark, condition_records=given, seed=1)
    assert made.count() == 40 and made.select("b", "i").exceptAll(given).count() == 0
    p.store(spark, str(tmp_path / "p"))
    assert Pipeline.load(spark, str(tmp_path / "p")).generate(spark, 60, seed=5).exceptAll(p.generate(spark, 60, seed=5)).count() == 0


def test_stream_is_coded(spark, mixed, tmp_path):
    from marginalia.streaming.transform import coded_stream

    t = mixed.select("i", "f")
    b = TableBinner("uniform", 5, None, DOMAIN).fit(t, public=True)
    t.write.parquet(str(tmp_path / "in"))
    q = coded_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), b).writeStream.format("memory").queryName("coded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("coded").exceptAll(b.transform(t)).count() == 0


def test_entry_works_without_the_llm_folder(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000 and set(entry.oracle_sql()) <= set(entry.queries())


def _reference_edges(x, low, high, bins):
    """Every leaf is split at its midpoint while it holds over n / bins rows, first in, first out, up to ``bins`` leaves."""
    queue, leaves = [(low, high, x)], [high]
    while queue:
        a, b, own = queue.pop(0)
        if len(own) > len(x) / bins and len(leaves) + len(queue) + 1 <= bins:
            mid = a + (b - a) / 2
            queue += [(a, mid, own[own < mid]), (mid, b, own[own >= mid])]
        else:
            leaves.append(a)
    return sorted(leaves)


@pytest.mark.parametrize("mass", [0, 2000])
def test_trees_of_skewed_columns_go_below_the_first_count(spark, mass):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.exp(rng.normal(5, 2, 4000)), rng.uniform(7.3e8, 7.3e8 + 40, 1000), np.full(mass, 123.456)])
    df = spark.createDataFrame([(float(v), float(v) / 2) for v in x], "x double, y double")
    b = TableBinner("priv-tree", 64, None, {"x": {"lower": 0, "upper": 1e9}, "y": {"lower": 0, "upper": 1e9}}).fit(df)
    for c, own in (("x", x), ("y", x / 2)):
        want = _reference_edges(own, 0.0, 1e9, 64)
        assert len(b.numeric[c].edges) == len(want) and np.allclose(b.numeric[c].edges, want, rtol=1e-12, atol=1e-9)
        assert min(np.diff(want)) < 1e9 / 4096
