"""Bins of columns against NumPy, few and very many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import expressions as X
from marginalia.types import Binning


@pytest.mark.parametrize("bins", [3, 129, 5000])
def test_codes_of_uneven_bins(spark, bins):
    rng = np.random.default_rng(1)
    edges = np.unique(np.concatenate(([0.0, 1e6], np.exp(rng.uniform(0, 13, bins - 1))))).tolist()
    values = [*np.exp(rng.uniform(-2, 15, 500)).tolist(), *edges[:50], -5.0, 0.0, 1e6, 2e6]
    df = spark.createDataFrame([(v,) for v in values], "v double").union(spark.sql("SELECT CAST(NULL AS DOUBLE) UNION ALL SELECT double('NaN')"))
    got = [r["c"] for r in df.select(X.bin_code(F.col("v"), edges).alias("c")).collect()]
    want = np.clip(np.searchsorted(edges, values, side="right") - 1, 0, len(edges) - 2).tolist()
    assert got == [*want, len(edges) - 2, len(edges) - 2]


@pytest.mark.parametrize("kind", ["double", "long"])
@pytest.mark.parametrize("bins", [4, 3000])
def test_values_lie_in_the_allowed_parts_of_their_bins(spark, bins, kind):
    edges = [10.0 * k for k in range(bins + 1)]
    b = Binning("v", kind, edges, "uniform", [(12.0, 14.0), (16.0, 17.0), (20.0, 30.0)])
    df = spark.range(bins * 4).select((F.col("id") % bins).cast("int").alias("c"), F.lit(0.125).alias("z"), (F.floor(F.col("id") / bins) / 4.0).alias("u"))
    for r in df.select("c", "u", X.bin_value(F.col("c"), b, F.col("u")).alias("x")).collect():
        low, high = edges[r["c"]], edges[r["c"] + 1]
        assert low <= r["x"] <= high
        if r["c"] == 1:
            assert not any(s < r["x"] < e for s, e in [(12, 14), (16, 17)])
        if kind == "double" and r["c"] not in (1, 2):
            assert r["x"] == pytest.approx(low + r["u"] * 10)
        if kind == "double" and r["c"] == 1:  # 7 allowed parts of 10: 10-12, 14-16, 17-20
            at = 7 * r["u"]
            assert r["x"] == pytest.approx(10 + at if at < 2 else 12 + at if at < 4 else 13 + at)


def test_long_tables_are_one_constant(spark):
    table = list(range(0, 4000, 2))
    df = spark.range(2000).select(X.lookup(F.col("id").cast("int"), table).alias("x"))
    assert [r["x"] for r in df.collect()] == table
    assert "from_json" not in df._jdf.queryExecution().executedPlan().toString()
