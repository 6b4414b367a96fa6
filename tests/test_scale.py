"""What strategies ask of large domains, how rows are dealt, and structures that come from rows: against brute force."""

import json
import re
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.contract import Chooser, Synthesizer
from marginalia.operators import boxes, generate, marginals, profile, stored
from marginalia.operators.marginals import TableCounts, cell_counts, count_cells, cube, redraw, rolled_up
from marginalia.pipeline import GraphicalGenerator, Pipeline
from marginalia.plans.compression import Compressor
from marginalia.plans.dual import Dual
from marginalia.plans.factors import Factor, GraphicalModel, SparseFactor
from marginalia.plans.inference import Measurement, estimate
from marginalia.plans.privacy import Noise
from marginalia.plans.select import STRATEGIES, Mst, Strategy
from marginalia.sources.tables import synthetic_codes
from marginalia.types import Domain

D = Domain.of({"a": 4, "b": 3, "c": 5, "d": 2})


def _joint(seed=0, domain=D, rows=3000):
    p = np.random.default_rng(seed).gamma(0.5, size=domain.shape)
    return Factor(domain, p * rows / p.sum())


# large domains


def test_rare_codes_are_merged_before_pairs_are_counted(spark, monkeypatch):
    """Two columns of 50,000 codes, almost all rare: what comes to the driver and the model are bounded by kept codes."""
    d = Domain.of({"x": 50_000, "y": 50_000, "z": 3})
    common = F.col("id") % 5 != 0
    code = lambda salt: F.when(common, F.col("id") % 4).otherwise(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(50_000))).cast("int")
    rows = spark.range(20_000).select(code("x").alias("x"), code("y").alias("y"), (F.col("id") % 3).cast("int").alias("z")).persist()
    sent = []
    count = marginals.count_cells
    monkeypatch.setattr(marginals, "count_cells", lambda *a: sent.append(count(*a)) or sent[-1])
    for strategy, params in (("mst", {"iters": 200}), ("aim", {"iters": 50, "rounds": 6, "max_cells": 10**10})):
        sent.clear()
        g = GraphicalGenerator(strategy, epsilon=1.0, seed=1, **params).set_domain(d).fit(rows)
        assert 5 <= g.compressor.small["x"] < 150 and 5 <= g.compressor.small["y"] < 150  # of 50,000 empty codes 70 or so pass three deviations
        pairs = [f for found in sent for c, f in found.items() if len(c) > 1]
        assert pairs and all(f.domain.size() < 150 * 150 for f in pairs)
        assert sum(f.domain.size() for f in g.model.potentials.values()) < 150 * 150 * 3
        assert g.generate(spark, 500).where("x >= 50000").count() == 0


def test_errors_of_pairs_of_a_million_codes_stay_in_spark(spark):
    d = Domain.of({"x": 1_000_000, "y": 1_000_000, "z": 7})
    rows = synthetic_codes(spark, d, 30_000, 4).withColumn("y", F.when(F.col("z") == 1, F.col("x")).otherwise(F.col("y"))).persist()
    counts = TableCounts(rows, d)
    ones = {a: f.datavector() for (a,), f in counts([(a,) for a in d]).items()}
    pairs = list(combinations(d.attrs, 2))
    got = counts.pair_errors(pairs, ones, 30_000.0)
    local = rows.toPandas()
    for a, b in pairs:
        n = local.groupby([a, b]).size()
        e = ones[a][n.index.get_level_values(0)] * ones[b][n.index.get_level_values(1)] / 30_000
        assert np.isclose(got[a, b], np.abs(n.to_numpy() - e).sum() + 30_000 - e.sum())


def test_sparse_tables_are_dense_ones():
    f = _joint(2)
    v = np.where(f.datavector() > 20, f.datavector(), 0)
    there = np.flatnonzero(v)[::-1]
    s = SparseFactor(D, there, v[there])
    assert np.allclose(s.datavector(), v) and np.isclose(s.sum(), v.sum()) and np.allclose(s.values, v.reshape(D.shape))
    for attrs in (("a",), ("c", "a"), ("d", "b", "a"), ()):
        assert np.allclose(s.project(attrs).datavector(), Factor(D, v).project(attrs).datavector() if attrs else v.sum())
    e = np.random.default_rng(1).random(D.size())
    assert np.isclose(s.l1(e.__getitem__, e.sum()), np.abs(v - e).sum())
    for a in D:
        assert np.isclose(marginals.mutual_information(s, a), marginals.mutual_information(Factor(D, v), a))


def test_only_the_largest_cliques_are_counted(spark):
    rows = synthetic_codes(spark, D, 2000, 5).persist()
    closure = [c for k in (1, 2, 3) for c in combinations(D.attrs, k)] + [("c", "a"), ("d", "b", "a")]
    largest = rolled_up(closure)
    assert set(map(frozenset, largest)) == set(map(frozenset, combinations(D.attrs, 3)))
    found = count_cells(rows, closure, D)
    local = rows.toPandas()
    for c in closure:
        want = np.zeros(D.size(c))
        np.add.at(want, np.ravel_multi_index([local[x] for x in c], [D[x] for x in c]), 1)
        assert np.array_equal(found[c].datavector(), want)
    assert cell_counts(rows, largest, D).count() < cell_counts(rows, closure, D).count()


def test_a_cube_is_made_of_cells(spark):
    rows = synthetic_codes(spark, D, 3000, 6).withColumn("b", F.when(F.col("b") > 0, F.col("b"))).persist()
    got = {tuple(r) for r in cube(rows, ["a", "b", "d"]).collect()}
    want = set()
    for keep in product((0, 1), repeat=3):
        names = [n for n, k in zip(("a", "b", "d"), keep, strict=True) if k]
        level = sum((1 - k) << (2 - i) for i, k in enumerate(keep))
        for r in rows.groupBy(*names).count().collect():
            want.add((*(r[n] if n in names else None for n in ("a", "b", "d")), level, r["count"]))
    assert got == want  # nulls of b and sums over b are told apart
    plan = cube(rows, ["a", "b", "d"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # rows are added up below the expansion


# inference


def test_merged_measurements_lead_to_the_same_model():
    f, rng = _joint(3), np.random.default_rng(4)
    ms = [Measurement(c, f.project(c).datavector() + rng.normal(size=D.size(c)) * s, s) for c in (("a", "b"), ("c", "b"), ("a",), ("c", "d")) for s in (3.0, 9.0, 1.5)]
    one = []
    for c in dict.fromkeys(m.clique for m in ms):
        own = [m for m in ms if m.clique == c]
        w = np.array([1 / m.sigma**2 for m in own])
        one.append(Measurement(c, sum(x * m.y for x, m in zip(w, own, strict=True)) / w.sum(), float(w.sum() ** -0.5)))
    models = [estimate(D, x, iters=3000, total=3000) for x in (ms, one)]
    for c in models[0].cliques:
        assert np.abs(models[0].project(c).values - models[1].project(c).values).max() < 1e-6 * 3000


@pytest.mark.parametrize("side", [512, 2])
def test_the_vector_of_tables_against_factors(monkeypatch, side):
    """Marginals, loss and gradient at random potentials, of tables read by products and along axes, in any order."""
    from marginalia.plans import dual as module

    monkeypatch.setattr(module, "SIDE", side)
    rng = np.random.default_rng(8)
    model = GraphicalModel(D, [("a", "b", "c"), ("c", "d")], 70.0, {"b": [1]})
    ms = [Measurement(c, rng.random(D.size(c)) * 20, 0.5 + rng.random(), rng.random(D.size(c)) + 0.1) for c in (("c", "a"), ("b",), ("d", "c"), ("c", "a"), ("b", "a", "c"), ("a",))]
    dual = Dual(model, ms)
    t = rng.normal(size=dual.size)
    mu = dual.vector(dual.marginals(t))
    full = model.belief_propagation(dual.vector(dual.potentials(t)))
    assert all(np.allclose(mu[c].values, full[c].values) for c in model.cliques)
    loss, grad = dual.loss(dual.read(dual.marginals(t)))
    far = [m.diagonal() * model_projection(mu, m.clique) - m.y for m in ms]
    assert np.isclose(loss, sum(0.5 * float(x @ x) / m.sigma**2 for x, m in zip(far, ms, strict=True)))
    assert np.isclose(grad.sum(), sum(float((x * m.diagonal()).sum()) / m.sigma**2 for x, m in zip(far, ms, strict=True)))


def model_projection(mu, clique):
    return next(f for c, f in mu.items() if set(clique) <= set(c)).project(clique).datavector()


@pytest.mark.parametrize("metric", ["L1", lambda mu: (0.5 * sum(float((f.values**2).sum()) for f in mu.values()), mu)])
def test_other_losses(metric):
    f = _joint(3)
    ms = [Measurement(c, f.project(c).datavector(), 1.0) for c in (("a", "b"), ("c", "b"))]
    m = estimate(D, ms, iters=200, metric=metric, step=(lambda k: 0.05 / (1 + k) ** 0.6) if metric == "L1" else 1e-3, total=3000)
    if metric == "L1":
        assert np.abs(m.project(("a", "b")).datavector() - ms[0].y).mean() < 20
    else:  # the least sum of squares is the even table
        assert np.allclose(m.project(("a", "b")).datavector(), 3000 / 12, rtol=0.05)


def test_strategies_and_pipelines_keep_their_contracts():
    assert issubclass(Strategy, Chooser) and all(issubclass(s, Chooser) for s in STRATEGIES.values())
    assert issubclass(GraphicalGenerator, Synthesizer) and issubclass(Pipeline, Synthesizer)
    for abstract in (Chooser, Synthesizer, Strategy):
        with pytest.raises(TypeError, match="abstract"):
            abstract()


# rows


def test_impossible_codes_of_equal_rows_go_evenly(spark):
    """Nothing but one column: rows of one code are equal, and each draws for itself."""
    d = Domain.of({"x": 7})
    rows = spark.range(7000).select((F.col("id") % 7).cast("int").alias("x"))
    new = redraw(rows, {"x": [3, 4, 5, 6]}, d, 2)
    n = {r["x"]: r["count"] for r in new.groupBy("x").count().collect()}
    assert sum(n.values()) == 7000 and set(n) == {0, 1, 2}
    assert all(abs(k - 7000 / 3) < 4 * (4000 * 2 / 9) ** 0.5 for k in n.values())
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    twice = [redraw(numbered, {"x": [3, 4]}, d, 5, row="at").orderBy("at").collect() for _ in range(2)]
    assert twice[0] == twice[1] and redraw(rows, {"x": []}, d) is rows


def test_a_group_of_all_rows_is_as_many_parts_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(generate, "ROWS_A_PART", 300)
    d = Domain.of({"a": 3, "b": 4})
    f = _joint(1, d, 6000)
    model = GraphicalModel(d, [("a", "b")], 6000).fit({("a", "b"): f})
    counts = spark.createDataFrame([(0, 6000), (1, 299)], "g long, m long")
    rows = spark.range(6299).select(F.col("id"), (F.col("id") >= 6000).cast("long").alias("g"))
    sizes = {(r["g"], r["_part"]): r["count"] for r in generate.parted(rows, "g", counts, 1, "x", "id").groupBy("g", "_part").count().collect()}
    assert len(sizes) == 21 and max(sizes.values()) < 400 and sizes[1, 0] == 299
    made = generate.generate(model, spark.range(6000).withColumnRenamed("id", "_row_id"), 3, "round").persist()
    one = {r["a"]: r["count"] for r in made.groupBy("a").count().collect()}
    assert all(abs(one[k] - f.project("a").datavector()[k]) <= 1 for k in range(3)) and made.count() == 6000
    both = {(r["a"], r["b"]): r["count"] for r in made.groupBy("a", "b").count().collect()}
    assert all(abs(both.get((i, j), 0) - f.values[i, j]) <= 1.5 for i in range(3) for j in range(4))


def _five(n):
    """A model with two cliques of three that share a pair, and a column of its own."""
    d = Domain.of({"a": 3, "b": 4, "c": 2, "e": 5, "f": 2})
    p = np.random.default_rng(4).gamma(0.8, size=d.shape)
    f = Factor(d, p * n / p.sum())
    model = GraphicalModel(d, [("a", "b", "c"), ("b", "c", "e"), ("f",)], n)
    model.fit({c: f.project(c) for c in model.cliques})
    g = GraphicalGenerator("mst", epsilon=None).set_domain(d)
    g.model, g.state, g.compressor = model, "trained", Compressor(d, {a: list(range(k)) for a, k in d.sizes.items()}, {})
    return d, f, g


def _shares(model, rows, given=()):
    """Each group's codes are its quotas: within one of its rows times the conditional table."""
    for a, on in generate.plan(model, given):
        table, sizes = generate.conditional(model, a, on), [model.domain[b] for b in on]
        cell = np.ravel_multi_index([rows[b].to_numpy() for b in on], sizes) if on else np.zeros(len(rows), int)
        found = np.zeros(table.shape)
        np.add.at(found, (cell, rows[a].to_numpy()), 1)
        assert (abs(found - found.sum(axis=1, keepdims=True) * table) <= 1 + 1e-6).all()


def test_numbered_rows_are_rounded_without_a_shuffle_of_rows(spark):
    n = 20_000
    d, f, g = _five(n)
    sc = spark.sparkContext
    stages = lambda: (x := sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)) and {x.apply(k).stageId(): x.apply(k).shuffleWriteRecords() for k in range(x.size())}
    earlier = stages()
    rows = g.generate(spark, n, seed=3).toPandas()
    later = {k: v for k, v in stages().items() if k not in earlier}
    assert later and max(later.values()) < n / 10  # cells and codes
    assert sorted(rows["_row_id"]) == list(range(n)) and rows[list(d.attrs)].notna().all(axis=None)
    _shares(g.model, rows)
    # a and e say nothing of each other beyond b and c, nor does f of any: differences as of even dealing
    for one, other, on in (("a", "e", ["b", "c"]), ("f", "a", []), ("f", "e", [])):
        far = freedom = 0
        for _, own in rows.groupby(on) if on else [(0, rows)]:
            t = own.groupby([one, other]).size().unstack(fill_value=0).to_numpy()
            want = t.sum(axis=1, keepdims=True) * t.sum(axis=0) / t.sum()
            far, freedom = far + ((t - want) ** 2 / want).sum(), freedom + (t.shape[0] - 1) * (t.shape[1] - 1)
        assert abs(far - freedom) < 4 * (2 * freedom) ** 0.5


def test_rounded_rows_are_the_same_for_every_plan(spark, monkeypatch):
    n = 3000
    d, f, g = _five(n)
    made = lambda: g.generate(spark, n, seed=3).orderBy("_row_id").collect()
    want = made()
    assert g.generate(spark, 0).count() == 0 and g.generate(spark, 1).count() == 1
    monkeypatch.setattr(generate, "COLUMNS_A_PLAN", 1)
    monkeypatch.setattr(generate, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(generate, "ROWS_A_PART", 200)
    assert made() == want
    given = spark.range(n).select((F.col("id") * 7 + 5).alias("_row_id"), (F.col("id") % 5).cast("int").alias("e"))
    rows = g.generate(spark, condition=given, seed=3).toPandas()
    assert sorted(rows["_row_id"]) == [7 * k + 5 for k in range(n)] and ((rows["_row_id"] - 5) // 7 % 5 == rows["e"]).all()
    _shares(g.model, rows, ("e",))


def test_a_fit_reads_its_rows_once(spark, tmp_path):
    """Where the whole domain has few cells; its measurements are those of the rows, with weights and without."""
    n = 6000
    synthetic = spark.range(n).select(*[F.pmod(F.xxhash64(F.lit(a), "id"), F.lit(D[a])).cast("int").alias(a) for a in D], (F.col("id") % 3).cast("double").alias("_n"))
    synthetic.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table = rows.toPandas()
    sc = spark.sparkContext
    stages = lambda: (x := sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)) and {x.apply(k).stageId(): x.apply(k).inputRecords() for k in range(x.size())}
    for strategy, weight in (("mst", None), ("mst", "_n"), ("priv-bayes", None)):
        earlier = stages()
        g = GraphicalGenerator(strategy, epsilon=None, compress=False).set_domain(D).fit(rows, marginals_only=True, weight=weight)
        read = sum(v for k, v in stages().items() if k not in earlier)
        assert n <= read < 2 * n
        for m in g.measurements:
            want = np.zeros([D[a] for a in m.clique])
            np.add.at(want, tuple(table[a].to_numpy() for a in m.clique), table["_n"].to_numpy() if weight else 1)
            assert np.array_equal(m.y, want.ravel())
    with pytest.raises(ValueError, match="codes outside"):
        GraphicalGenerator("mst", epsilon=None).set_domain({**D.sizes, "a": 3}).fit(rows)


def test_a_generated_column_is_compiled_code(spark):
    """Every stage of the rows is compiled, no method is too long for the JVM to compile it (8,000 bytes), and no lambda
    walks the quotas."""
    d, f, g = _five(3000)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = g.generate(spark, 3000, seed=3).groupBy(*d.attrs).count()
        code = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > len(d) and 0 < max(sizes) < 8000
    assert "lambdafunction" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 2, 5, 8, 300])
def test_edges_reached_are_found_by_halves(spark, most):
    edges = [3 * k for k in range(1, most + 1)]
    rows = spark.range(3 * most + 4).withColumn("edges", F.array(*[F.lit(e).cast("long") for e in edges]))
    out = generate.reached(rows, "id", "edges", most, "k").select("id", "k").collect()
    assert all(r["k"] == sum(e <= r["id"] for e in edges) for r in out)


def test_places_are_permuted_whole(spark):
    sizes = [*range(1, 40), 1000, 4097]
    places = spark.createDataFrame([(m, i) for m in sizes for i in range(m)], "m long, i long")
    out = generate.permuted(places, F.col("i"), F.col("m"), F.xxhash64(F.lit(1), "m"), "to").toPandas()
    assert all(sorted(own["to"]) == list(range(m)) for m, own in out.groupby("m")) and len(out) == sum(sizes)
    assert (out["i"] == out["to"]).sum() < 4 * len(sizes)


def test_tables_beyond_a_broadcast_give_the_same_rows(spark, monkeypatch):
    d = Domain.of({"a": 30, "b": 4, "c": 3})
    p = np.random.default_rng(2).gamma(0.3, size=d.shape)
    p[0] *= 50  # a hot cell
    f = Factor(d, p * 9000 / p.sum())
    model = GraphicalModel(d, [("a", "b"), ("a", "c")], 9000)
    model.fit({c: f.project(c) for c in model.cliques})
    rows = spark.range(9000).withColumnRenamed("id", "_row_id")
    want = generate.generate(model, rows, 3, "sample").orderBy("_row_id").collect()
    monkeypatch.setattr(generate, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(generate, "ROWS_A_PART", 200)
    assert generate.generate(model, rows, 3, "sample").orderBy("_row_id").collect() == want
    cells = spark.createDataFrame([(int(k),) for k in np.minimum(np.random.default_rng(1).zipf(1.3, 9000), 30) - 1], "_cell long").withColumn("id", F.monotonically_increasing_id())
    dealt = generate.parted(cells, "_cell", cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("m")), 1, "y", "id")
    assert dealt.groupBy("_cell", "_part").count().agg(F.max("count")).first()[0] < 2 * 200


# columns


def test_values_of_all_columns_come_from_one_job(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 2 == 0).alias("yes"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4 - 2) * 0.0).alias("zero")).repartition(6)
    sc = spark.sparkContext
    jobs = []
    for run in (lambda: profile.distinct_values(rows, rows.columns, 10), lambda: profile.distinct_counts(rows, rows.columns)):
        sc.setJobGroup(f"values {len(jobs)}", "")
        jobs.append((run(), len(sc.statusTracker().getJobIdsForGroup(f"values {len(jobs)}"))))
    sc.setLocalProperty("spark.jobGroup.id", None)
    (values, first), (counts, second) = jobs
    assert values == {"many": None, "few": ["0", "1", "2"], "yes": ["false", "true"], "none": [], "zero": ["0.0"]}
    assert counts == {"many": 3000, "few": 3, "yes": 2, "none": 0, "zero": 1}
    assert first <= 4 and second <= 4  # stages of an adaptive plan, not a job for each of five columns
    assert profile.distinct_values(rows, [], 3) == {} and profile.distinct_values(rows, ["few"], 2) == {"few": None}


def _plain_tree(points, bounds, bins, cap=None):
    """Boxes of a noise-free tree, by splitting lists of points."""
    theta, out, level, n = len(points) / bins, [], [(tuple(bounds), points)], 1
    while level:
        below = []
        for box, own in level:
            if len(own) > theta and (cap is None or n + 2 ** len(box) - 1 <= cap):
                n += 2 ** len(box) - 1
                halves = [((lo, (lo + hi) / 2), ((lo + hi) / 2, hi)) for lo, hi in box]
                for child in product(*halves):
                    below.append((child, [p for p in own if all(lo <= x < hi for x, (lo, hi) in zip(p, child, strict=True))]))
            else:
                out.append((box, len(own)))
        level = below
    return sorted(out)


@pytest.mark.parametrize(("dims", "cap"), [(1, None), (2, None), (3, None), (2, 40)])
def test_trees_of_several_columns_are_those_of_lists_of_points(spark, dims, cap):
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.random((300, dims)) * 64, 3 + rng.random((500, dims)) / 900])  # a dense corner: many levels
    rows = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None, *[1.0] * (dims - 1))], [f"x{k}" for k in range(dims)])
    found = boxes.fit_boxes(rows, {f"x{k}": ("double", 0.0, 64.0) for k in range(dims)}, 20, None, Noise(0), cap)
    n = {r["box"]: r["count"] for r in rows.groupBy(found.code().alias("box")).count().collect()}
    got = sorted((tuple(found.bounds(k)), n.get(k, 0)) for k in range(found.n_bins))
    assert got == _plain_tree(points.tolist(), [(0.0, 64.0)] * dims, 20, cap) and n[None] == 1
    back = rows.where("x0 is not null").withColumn("r", F.monotonically_increasing_id()).withColumn("k", found.code())
    back = back.select("k", *found.inverse(F.col("k"), F.col("r"), 3))
    assert back.where(found.code() != F.col("k")).count() == 0
    noisy = boxes.fit_boxes(rows, {f"x{k}": ("double", 0.0, 64.0) for k in range(dims)}, 20, 1.0, Noise(1), 60)
    assert 1 <= noisy.n_bins <= 60


# stored models


def test_marginals_of_stored_tables_are_the_models(spark):
    rng = np.random.default_rng(5)
    model = GraphicalModel(D, [("a", "b"), ("b", "c"), ("d",)], 50)
    for c in model.cliques:
        model.potentials[c] = Factor(D.project(c), rng.normal(size=D.project(c).shape))
    model.marginals = model.belief_propagation(model.potentials)
    g = GraphicalGenerator("mst").set_domain(D)
    g.model = model
    tables = stored.clique_tables(spark.createDataFrame(g.values()), D, model.cliques)
    for attrs in (("a",), ("c", "a"), ("a", "c", "b"), ("c",), ("a", "d"), ("d", "c", "a")):
        found = {tuple(r[a] for a in attrs): r["value"] for r in stored.table_marginal(tables, model.tree, attrs).collect()}
        want = model.project(attrs)
        assert len(found) == want.values.size and all(np.isclose(found[k], want.values[k]) for k in found)
    with pytest.raises(ValueError, match="share no attribute"):
        marginals.PRODUCT_CELLS, before = 3, marginals.PRODUCT_CELLS
        try:
            stored.table_marginal(tables, model.tree, ("a", "d"))
        finally:
            marginals.PRODUCT_CELLS = before


@pytest.mark.parametrize("strategy", ["mst", "aim", "priv-bayes"])
def test_models_come_back_from_their_stores(spark, tmp_path, strategy):
    rows = synthetic_codes(spark, D, 800, 3).withColumn("x", F.lit("kept out")).drop("x")
    small = {"mst": {"iters": 20}, "aim": {"iters": 20, "rounds": 4}, "priv-bayes": {"iters": 20}}[strategy]
    g = GraphicalGenerator(strategy, epsilon=1.0, seed=3, **small).set_domain(D).set_structural_zeros({"c": [4]}).fit(rows)
    g.store(spark, str(tmp_path / "m"))
    back = GraphicalGenerator.load(spark, str(tmp_path / "m"))
    assert json.loads(back.to_json()) == json.loads(g.to_json())
    assert back.generate(spark, 60, seed=2).collect() == g.generate(spark, 60, seed=2).collect()
    text = (tmp_path / "m" / "model.json").read_text()
    assert len(text) < 3000 and '"y": null' in text


# the matrix of settings


@pytest.mark.parametrize(("strategy", "compress", "size", "epsilon", "condition", "zeros", "stored_"), [(s, *rest) for k, rest in enumerate(product((True, False), (None, 80), (None, 1.0), (True, False), (True, False), (True, False))) for s in ("mst", "aim", "priv-bayes") if bin(k).count("1") % 2 == 0 and k % 3 == ("mst", "aim", "priv-bayes").index(s)])  # half of them: each set of five settings is met in all its values
def test_settings_go_together(spark, tmp_path, strategy, compress, size, epsilon, condition, zeros, stored_):
    d = Domain.of({"p": 12, "q": 30, "r": 7})
    rows = synthetic_codes(spark, d, 1500, 9).persist()
    own = {"mst": {}, "aim": {"rounds": 3}, "priv-bayes": {"degree": 1}}[strategy]
    g = GraphicalGenerator(strategy, epsilon=epsilon, compress=compress, max_model_size=size, iters=10, seed=1, **own).set_domain(d)
    if zeros:
        g.set_structural_zeros({"q": [0, 5, 29]})
    g.fit(rows)
    if stored_:
        g.store(spark, str(tmp_path / "s"))
        g = GraphicalGenerator.load(spark, str(tmp_path / "s"))
    if condition:
        given = rows.select("r").limit(50).withColumn("_row_id", F.monotonically_increasing_id()).persist()
        made = g.generate(spark, condition=given)
        assert made.select("_row_id", "r").exceptAll(given.select("_row_id", "r")).count() == 0
    else:
        made = g.generate(spark, 50)
    got = made.collect()
    assert len(got) == 50 and all(0 <= r[a] < d[a] for r in got for a in d)
    assert not zeros or all(r["q"] not in (0, 5, 29) for r in got)


def test_mst_weighs_what_its_model_leaves_unsaid(spark):
    rows = synthetic_codes(spark, D, 2000, 7).withColumn("b", F.col("a") % 3).persist()
    counts, mst, ones = TableCounts(rows, D), Mst(epsilon=None), [(a,) for a in D]
    weights = mst.weights(D, counts, mst.measure(counts(ones), ones, None), list(combinations(D.attrs, 2)))
    assert max(weights, key=weights.get) == ("a", "b")
