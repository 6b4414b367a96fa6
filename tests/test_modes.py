"""Public pretraining, private fits and what they cost; noise of any scale; counts however the rows are batched."""

import warnings
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import marginals
from marginalia.pipeline import GraphicalGenerator, Pipeline
from marginalia.plans.privacy import Noise, _rounded_up
from marginalia.sources.tables import synthetic_codes
from marginalia.types import Domain

D = Domain.of({"x": 4, "y": 3, "z": 5})
FAST = {"mst": {"iters": 10}, "aim": {"iters": 10, "rounds": 5}, "priv-bayes": {"iters": 10, "degree": 1}}


@pytest.fixture(scope="module")
def tables(spark):
    return synthetic_codes(spark, D, 2000, 1).persist(), synthetic_codes(spark, D, 1500, 2).persist()


@pytest.mark.parametrize("mode", ["pretrain_only", "pretrain_and_fit", "fit_only", "marginals_then_fit", "fit_twice"])
@pytest.mark.parametrize("strategy", ["mst", "aim", "priv-bayes"])
def test_fit_modes(spark, tables, strategy, mode):
    public, private = tables
    g = GraphicalGenerator(strategy, epsilon=1.0, seed=3, **FAST[strategy]).set_domain(D)
    spent = lambda: g.strategy.ledger.total(g.strategy.delta)
    if mode.startswith("pretrain"):
        g.fit(public, public=True)
        assert g.state == "pretrained" and g.model is None and spent() == 0
        g = GraphicalGenerator.from_json(g.to_json())
    chosen = {m.clique for m in g.measurements}
    if mode == "pretrain_only":
        with pytest.raises(ValueError, match="not trained"):
            g.generate(spark, 10)
        return
    if mode == "marginals_then_fit":
        g.fit(private, marginals_only=True)
        paid, seen = spent(), [m.y.tolist() for m in g.measurements]
        assert g.state == "pretrained" and paid > 0
        g.fit(private)
        assert spent() == paid and [m.y.tolist() for m in g.measurements] == seen
    else:
        g.fit(private)
    assert g.state == "trained" and 0 < spent() <= 1.0 + 1e-6
    if mode == "pretrain_and_fit":
        assert {m.clique for m in g.measurements} == chosen and [e[0] for e in g.strategy.ledger.entries] == ["measure"]
        assert abs(sum(g.measurements[0].y) - 1500) < 400  # the private table's, not the public one's
    if mode == "fit_twice":
        g.fit(private)
        assert g.state == "trained" and spent() > 1.0  # it pays again, and says so
    assert g.generate(spark, 40).count() == 40


def test_a_pipeline_pretrained_on_public_rows(spark):
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    domain = {"v": {"lower": 0, "upper": 6}, "c": {"categories": ["a", "b"]}}
    p = Pipeline("mst", epsilon=1.0, proc_epsilon=0.5, n_bins=4, iters=10).set_random_state(1)
    p.fit(rows, domain, public=True)
    assert p.spent_epsilon == 0
    with pytest.raises(ValueError, match="not trained"):
        p.generate(spark, 5)
    p.fit(rows)
    assert 0 < p.spent_epsilon <= 1.5 and p.generate(spark, 30).count() == 30


def test_a_seed_set_later_decides(spark, tables):
    made = []
    for seed in (5, 5, 6):
        g = GraphicalGenerator("mst", epsilon=1.0, iters=10).set_domain(D).set_random_state(seed)
        made.append([m.y.tolist() for m in g.fit(tables[1]).measurements])
    assert made[0] == made[1] != made[2]
    g.set_params(iters=3)
    assert g.strategy.iters == 3
    with pytest.raises(ValueError, match="no parameter"):
        g.set_params(nothing=1)


@pytest.mark.parametrize("scale", [1e-9, 1e-5, 0.005, 0.3, 1.0, 7.7, 1e6])
def test_noise_of_any_positive_scale(scale):
    exact = Fraction(scale) ** 2
    assert exact <= _rounded_up(exact) <= exact * (1 + Fraction(1, 1 << 19))
    g, lap = Noise(1).gaussian(scale, 300), Noise(2).laplace(scale, 300)
    assert len(g) == len(lap) == 300
    if scale < 0.01:
        assert not g.any() and not lap.any()
    if scale >= 7:
        assert abs(g.std() / scale - 1) < 0.2 and abs(lap.std() / (scale * 2**0.5) - 1) < 0.3


def test_counts_do_not_depend_on_batches(spark, monkeypatch):
    d = Domain.of({"a": 50, "b": 40, "c": 3})
    df = synthetic_codes(spark, d, 5000, 3).withColumn("w", F.col("a") * 0.5).persist()
    cliques = [("a", "b"), ("c",), ("a", "b", "c")]
    want = {c: np.zeros(d.size(c)) for c in cliques}
    for r in df.collect():
        for c in cliques:
            want[c][np.ravel_multi_index([r[x] for x in c], [d[x] for x in c])] += 1
    for rows, dense, batch in ((1, 2_000_000, "100"), (1 << 17, 2_000_000, "10000"), (700, 1000, "10000")):
        monkeypatch.setattr(marginals, "ROWS_A_PASS", rows)
        monkeypatch.setattr(marginals, "DENSE_CELLS", dense)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = marginals.count_cells(df, cliques, d)
        assert all((found[c].datavector() == want[c]).all() for c in cliques)
        weighted = marginals.count_cells(df, [("a",)], d, "w")["a",].datavector()
        assert np.allclose(weighted, want["a", "b"].reshape(50, 40).sum(axis=1) * np.arange(50) * 0.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_domain_wider_than_the_data(spark):
    from marginalia.operators.binning import TableBinner

    t = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "B"), (5, "C")], "num long, cat string")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        b = TableBinner("uniform", 5, None, {"num": {"lower": 0, "upper": 10}, "cat": {"categories": list("ABCD")}}).fit(t, public=True)
    wide = spark.createDataFrame([(0, "A"), (2, "B"), (4, "C"), (10, "D")], "num long, cat string")
    got = [tuple(r) for r in b.transform(wide).select("num", "cat").collect()]
    assert [c for _, c in got] == [0, 1, 2, 3] and [n for n, _ in got] == sorted(n for n, _ in got) and got[-1][0] == 4
    assert b.set_params(n_bins=3).n_bins == 3
    with pytest.raises(ValueError, match="no parameter"):
        b.set_params(bins=3)


def test_impossible_codes_are_drawn_again(spark, tables):
    rows = tables[0]
    new = marginals.redraw(rows, {"x": [1, 2], "z": []}, D, 4).persist()
    assert new.where("x in (1, 2)").count() == 0 and new.count() == rows.count()
    assert new.select("y", "z").exceptAll(rows.select("y", "z")).count() == 0
    moved = rows.where("x in (1, 2)").count()
    assert abs(new.where("x = 0").count() - rows.where("x = 0").count() - moved / 2) < moved / 5
    g = GraphicalGenerator("mst", epsilon=None, iters=50, compress=False).set_domain(D).set_structural_zeros({"x": [1, 2]}).fit(rows)
    one = next(m for m in g.measurements if m.clique == ("x",))
    assert sum(one.y) == rows.count() and one.y[1] == one.y[2] == 0
    assert g.generate(spark, 100).where("x in (1, 2)").count() == 0
    with pytest.raises(ValueError, match="possible"):
        marginals.redraw(rows, {"y": [0, 1, 2]}, D)
