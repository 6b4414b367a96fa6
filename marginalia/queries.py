"""Queries over the driver's tables for the engine's own operators, with their SQL."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import expressions as X
from marginalia.operators import marginals as M
from marginalia.operators.binning import TableBinner, optimal_bins, private_tree, dyadic_counts, uniform_edges
from marginalia.operators.boxes import fit_boxes
from marginalia.operators.cut import shared_folder
from marginalia.operators.generate import quotas
from marginalia.operators.profile import bounds_histogram, distinct_counts, private_bounds, profile
from marginalia.operators.stored import clique_tables, table_marginal
from marginalia.pipeline import GraphicalGenerator, Pipeline
from marginalia.plans.compression import Compressor
from marginalia.plans.factors import CliqueVector, GraphicalModel
from marginalia.plans.inference import Measurement
from marginalia.plans.privacy import Noise
from marginalia.plans.select import STRATEGIES, Mst, workload_scores
from marginalia.sources.tables import load_coded, read_table, write_text
from marginalia.streaming.transform import coded_stream
from marginalia.types import Binning, Domain, Encoding

FLAGS, STATUS = ["A", "N", "R"], ["F", "O"]
CATS = ("l_returnflag", "l_linestatus", "l_linenumber")
SIZES = Domain.of({"l_returnflag": 3, "l_linestatus": 2, "l_linenumber": 7, "qty": 10})
QTY = Binning("l_quantity", "double", uniform_edges(0.5, 50.5, 10))


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Four coded columns of lineitem."""
    return _t(spark, d, "lineitem").select(
        X.encode(F.col("l_returnflag"), Encoding("l_returnflag", FLAGS)).alias("l_returnflag"),
        X.encode(F.col("l_linestatus"), Encoding("l_linestatus", STATUS)).alias("l_linestatus"),
        (F.col("l_linenumber") - 1).cast("int").alias("l_linenumber"),
        X.bin_code(X.to_number(F.col("l_quantity"), "double"), QTY.edges).alias("qty"),
    )


_QTY_SQL = "CAST(least(greatest(floor((l_quantity - 0.5) / 5), 0), 9) AS INT)"
_CODED_SQL = f"(SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS l_linestatus, CAST(l_linenumber - 1 AS INT) AS l_linenumber, {_QTY_SQL} AS qty FROM lineitem)"


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    found = profile(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], exact=True)
    rows = [(c, p.rows, p.missing, p.distinct, p.static, float(p.low), float(p.high)) for c, p in found.items()]
    return spark.createDataFrame(rows, "name string, n long, n_null long, n_distinct long, static boolean, low double, high double")


def encode_categories(spark: SparkSession, d: str) -> DataFrame:
    binner = TableBinner("uniform", domain={})
    t = _t(spark, d, "customer").select("c_mktsegment")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        binner.fit(t, public=True)
    return t.select("c_mktsegment", X.encode(F.col("c_mktsegment"), binner.coded["c_mktsegment"]).alias("code")).groupBy("c_mktsegment", "code").agg(F.count(F.lit(1)).alias("n"))


def bin_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).groupBy("qty").agg(F.count(F.lit(1)).alias("n"))


def bin_optimal_count(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "lineitem").count()
    return spark.range(1).select(F.lit(optimal_bins(n)).cast("int").alias("n_bins"))


def bin_privtree_noise_free(spark: SparkSession, d: str) -> DataFrame:
    """Leaves and rows of the noise-free tree over prices, theta = rows / 8 and no binding cap (n_bins is the theta's)."""
    t = _t(spark, d, "lineitem")
    lo, hi = 0.0, 131072.0
    counts = dyadic_counts(t, {"l_extendedprice": ("double", lo, hi)})["l_extendedprice"]
    edges = private_tree(counts, lo, hi, 64, None, Noise(0), cap=4096)
    code = X.bin_code(F.col("l_extendedprice"), edges)
    return t.groupBy(X.lookup(code, edges[:-1]).alias("low"), X.lookup(code, edges[1:]).alias("high")).agg(F.count(F.lit(1)).alias("n"))


def bin_inverse_midpoint(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).select("qty", X.bin_value(F.col("qty"), QTY, F.lit(0.5)).alias("mid")).groupBy("qty", "mid").agg(F.count(F.lit(1)).alias("n"))


def marginal_1way(spark: SparkSession, d: str) -> DataFrame:
    return M.marginal(_coded(spark, d), ["l_returnflag"])


def marginal_2way(spark: SparkSession, d: str) -> DataFrame:
    return M.marginal(_coded(spark, d), ["l_returnflag", "qty"])


def marginal_3way(spark: SparkSession, d: str) -> DataFrame:
    return M.marginal(_coded(spark, d), ["l_returnflag", "l_linestatus", "qty"])


def marginal_weighted(spark: SparkSession, d: str) -> DataFrame:
    return M.marginal(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "w")


def marginals_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pair tables from one pass."""
    pairs = list(combinations(SIZES.attrs, 2))
    found = M.count_cells(_coded(spark, d), pairs, SIZES)
    rows = [(a, b, i, j, int(f.values[i, j])) for (a, b), f in found.items() for i in range(SIZES[a]) for j in range(SIZES[b]) if f.values[i, j]]
    return spark.createDataFrame(rows, "a string, b string, i int, j int, n long")


def marginal_dense(spark: SparkSession, d: str) -> DataFrame:
    return M.dense_marginal(_coded(spark, d), ["l_returnflag", "l_linestatus", "qty"], SIZES)


def marginal_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.factor_sum(marginal_3way(spark, d), ["qty"], "n")


def marginal_datetime(spark: SparkSession, d: str) -> DataFrame:
    """Twenty equal bins of order dates between 1992 and 2000."""
    lo, hi = 694224000 * X.MICROS, 946684800 * X.MICROS
    t = _t(spark, d, "orders")
    code = X.bin_code(X.to_number(F.col("o_orderdate"), "timestamp_ntz"), uniform_edges(float(lo), float(hi), 20))
    return t.groupBy(code.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_BALANCE = {"c_acctbal": "double", "c_custkey": "long"}


def bounds_histogram_query(spark: SparkSession, d: str) -> DataFrame:
    found = bounds_histogram(_t(spark, d, "customer"), _BALANCE)
    return spark.createDataFrame([(c, b, n) for c, own in found.items() for b, n in own.items()], "name string, bin int, n long")


def private_bounds_noise_free(spark: SparkSession, d: str) -> DataFrame:
    found = bounds_histogram(_t(spark, d, "customer"), _BALANCE)
    return spark.createDataFrame([(c, *private_bounds(own, None, Noise(0))) for c, own in found.items()], "name string, low double, high double")


def entropy_1way(spark: SparkSession, d: str) -> DataFrame:
    found = M.count_cells(_coded(spark, d), [(a,) for a in SIZES], SIZES)
    return spark.createDataFrame([(a, round(M.entropy(f.datavector()), 6)) for (a,), f in found.items()], "a string, h double")


def mutual_information_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = M.count_cells(_coded(spark, d), combinations(SIZES.attrs, 2), SIZES)
    return spark.createDataFrame([(*c, round(M.mutual_information(f, c[1]), 6)) for c, f in found.items()], "a string, b string, mi double")


def _error_weights(spark: SparkSession, d: str) -> dict:
    counts, mst, ones = M.TableCounts(_coded(spark, d), SIZES), Mst(epsilon=None), [(a,) for a in SIZES]
    return mst.weights(SIZES, counts, mst.measure(counts(ones), ones, None), list(combinations(SIZES.attrs, 2)))


def mst_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(*c, round(w, 1)) for c, w in _error_weights(spark, d).items()], "a string, b string, w double")


def mst_edges_noise_free(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(Mst(epsilon=None).tree(SIZES, _error_weights(spark, d), None), "a string, b string")


def workload_scores_query(spark: SparkSession, d: str) -> DataFrame:
    """Each subset of a workload's cliques with its score, its occupied cells and its rows, from one job."""
    work = [("l_returnflag", "l_linestatus"), ("l_linestatus", "qty"), ("l_linenumber", "qty")]
    scores = workload_scores(work)
    found = M.count_cells(_coded(spark, d), scores, SIZES)
    return spark.createDataFrame([("+".join(sorted(c)), s, len(found[c].cells), int(found[c].total)) for c, s in scores.items()], "clique string, score int, n_cells long, n long")


def _compressor(spark: SparkSession, d: str) -> Compressor:
    y = M.count_cells(_coded(spark, d), [("l_linenumber",)], SIZES)["l_linenumber",].datavector()
    return Compressor.fit(SIZES.project(("l_linenumber",)), [Measurement(("l_linenumber",), y, float(y.sum()) / 7 / 3)], threshold=3.0)


def compress_supports(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _compressor(spark, d).kept["l_linenumber"]], "code int")


def compress_transform(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).groupBy(_compressor(spark, d).transform("l_linenumber").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def compress_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Codes after compression and back: kept ones as they were, merged ones as one of themselves (here -1)."""
    c = _compressor(spark, d)
    small = _coded(spark, d).select(c.transform("l_linenumber").alias("l_linenumber"), F.monotonically_increasing_id().alias("_row_id"))
    back = small.select(c.reverse("l_linenumber", 3).alias("k"))
    return back.groupBy(F.when(F.col("k").isin(c.kept["l_linenumber"]), F.col("k")).otherwise(-1).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _quantities(spark: SparkSession, d: str) -> tuple[DataFrame, TableBinner]:
    t = _t(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("_row_id"), F.when(F.col("l_quantity") >= 5, F.col("l_quantity").cast("double")).alias("q"), "l_returnflag")
    b = TableBinner("uniform", 9, domain={"q": {"lower": 5, "upper": 50}, "l_returnflag": {"categories": FLAGS}}, seed=3)
    return t, b.fit(t.drop("_row_id"), public=True)


def binner_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Values drawn from their bins and coded again, nulls restored: the counts of the first codes."""
    t, b = _quantities(spark, d)
    back = b.inverse(b.transform(t, keep=("_row_id",)), seed=5)
    code = F.floor((F.col("q") - 5) / 5).cast("int")
    return back.groupBy("l_returnflag", F.least(code, F.lit(8)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_restore(spark: SparkSession, d: str) -> DataFrame:
    t, b = _quantities(spark, d)
    back = b.inverse(b.transform(t, keep=("_row_id",)), seed=5)
    return back.agg(F.count_if(F.col("q").isNull()).alias("n_null"), F.count("q").alias("n"))


def null_flag_fill(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "lineitem").select(F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).alias("q"))
    b = TableBinner("uniform", 10).fit(t, public=True)
    coded = b.transform(t)
    return coded.groupBy(F.col(b.flags["q"]).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNull()).alias("n_null"))


def _factors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _coded(spark, d)
    f = lambda cols: M.marginal(c, cols, None, "value").withColumn("value", F.col("value").cast("double"))
    return f(["l_returnflag", "l_linestatus"]), f(["l_linestatus", "qty"])


def factor_product(spark: SparkSession, d: str) -> DataFrame:
    return M.factor_product(*_factors(spark, d))


def factor_divide(spark: SparkSession, d: str) -> DataFrame:
    a, b = _factors(spark, d)
    return M.factor_divide(a, M.factor_sum(b, ["l_linestatus"])).withColumn("value", F.round("value", 9))


def factor_condition(spark: SparkSession, d: str) -> DataFrame:
    return M.factor_condition(_factors(spark, d)[1], {"l_linestatus": 1})


def conditional_distribution(spark: SparkSession, d: str) -> DataFrame:
    pair = _factors(spark, d)[0]
    return M.factor_divide(pair, M.factor_sum(pair, ["l_linestatus"])).withColumn("value", F.round("value", 9))


def quota_round(spark: SparkSession, d: str) -> DataFrame:
    """Quotas of each flag in each status for as many rows as there are: its rows, exactly."""
    p = conditional_distribution_exact(spark, d)
    table = p.groupBy(F.col("l_linestatus").cast("long").alias("_cell")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "value"))), lambda s: s["value"]).alias("_p"))
    groups = M.marginal(_coded(spark, d), ["l_linestatus"], name="m").select(F.col("l_linestatus").cast("long").alias("_cell"), "m")
    q = quotas(groups, table, 0, "q")
    return q.select(F.col("_cell").cast("int").alias("l_linestatus"), F.col("code").cast("int").alias("nth"), (F.col("hi") - F.col("lo")).cast("long").alias("n"))


def conditional_distribution_exact(spark: SparkSession, d: str) -> DataFrame:
    pair = _factors(spark, d)[0]
    return M.factor_divide(pair, M.factor_sum(pair, ["l_linestatus"]))


def generate_rounded(spark: SparkSession, d: str, stored: bool = False, strategy: str = "mst", **params) -> DataFrame:
    """One-way tables of as many rows as there are, generated by "round" from a noise-free model: those of the data."""
    rows = _coded(spark, d)
    g = GraphicalGenerator(strategy, epsilon=None, compress=False, **params).set_domain(SIZES).fit(rows)
    n = rows.count()
    if stored:
        g = GraphicalGenerator.from_json(g.to_json())
    made = g.generate(spark, n, seed=1)
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("int").alias("code")) for a in SIZES])
    return M.marginal(made, list(SIZES)).select(F.explode(each).alias("e"), "n").groupBy("e.a", "e.code").agg(F.sum("n").alias("n"))


def generate_from_json(spark: SparkSession, d: str) -> DataFrame:
    """The same from a model that was written as JSON and read again."""
    return generate_rounded(spark, d, stored=True)


def generate_rounded_privbayes(spark: SparkSession, d: str) -> DataFrame:
    return generate_rounded(spark, d, strategy="priv-bayes")


def stream_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes that a frozen discretisation gives to a stream of the table's files."""
    t = _t(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    b = TableBinner("uniform", 10, domain={"l_quantity": {"lower": 0, "upper": 50}, "l_returnflag": {"categories": FLAGS}}).fit(t, public=True)
    stream = spark.readStream.schema(_t(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parq[u]et").select("l_returnflag", "l_quantity")
    name = f"coded_{uuid.uuid4().hex}"
    coded = coded_stream(stream, b).groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    coded.writeStream.format("memory").outputMode("complete").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("l_returnflag", F.col("l_quantity").alias("qty"), "n")


def redrawn_codes(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers after the last four are drawn again: rows that had each code before, and what share of the drawn
    rows went to it, to a tenth."""
    was = _coded(spark, d).withColumn("was", F.col("l_linenumber"))
    new = M.redraw(was, {"l_linenumber": [3, 4, 5, 6]}, SIZES, 7)
    drawn = F.col("was") > 2
    moved = new.groupBy(F.col("l_linenumber").alias("code")).agg(F.count_if(~drawn).alias("n"), F.count_if(drawn).alias("m"))
    return moved.select("code", "n", F.round(F.col("m") / F.sum("m").over(W.partitionBy()), 1).alias("share"))


RARE = Domain.of({"l_linenumber": 7, "quantity": 50, "discount": 11})


def _rare(spark: SparkSession, d: str) -> tuple[DataFrame, Compressor]:
    """Three coded columns of lineitem, and the compression that keeps codes of at least the mean count."""
    t = _t(spark, d, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("l_linenumber"), (F.col("l_quantity").cast("int") - 1).alias("quantity"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"))
    ones = M.TableCounts(t, RARE)([(a,) for a in RARE])
    return t, Compressor.fit(RARE, [Measurement(c, f.datavector(), f.total / RARE.size(c) / 3) for c, f in ones.items()], threshold=3.0)


def compressed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pair tables over compressed codes: supports from one count, pairs from a second one."""
    t, c = _rare(spark, d)
    pairs = list(combinations(RARE.attrs, 2))
    cells = M.cell_counts(M.TableCounts(t, RARE).compressed(c).df, pairs, c.small)
    out = []
    for k, (a, b) in enumerate(pairs):
        own = cells.where(F.col("clique") == k)
        out.append(own.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.floor(F.col("cell") / c.small[b]).cast("int").alias("i"), (F.col("cell") % c.small[b]).cast("int").alias("j"), F.col("n").cast("long").alias("n")))
    return out[0].union(out[1]).union(out[2])


def compressed_pair_errors(spark: SparkSession, d: str) -> DataFrame:
    """What the one-way tables' product leaves unsaid of each pair of compressed columns, found in Spark."""
    t, c = _rare(spark, d)
    counts = M.TableCounts(t, RARE).compressed(c)
    ones = counts([(a,) for a in c.small])
    found = counts.pair_errors(list(combinations(RARE.attrs, 2)), {a: f.datavector() for (a,), f in ones.items()}, ones["quantity",].total)
    return spark.createDataFrame([(*p, round(w, 3)) for p, w in found.items()], "a string, b string, w double")


_BOXES = {"l_extendedprice": ("double", 0.0, 131072.0), "l_quantity": ("double", 0.0, 64.0)}


def bin_privtree_2d(spark: SparkSession, d: str) -> DataFrame:
    """Leaves with rows of the noise-free tree over prices and quantities together, theta = rows / 64."""
    t = _t(spark, d, "lineitem")
    boxes = fit_boxes(t, _BOXES, 64, None, Noise(0))
    n = t.groupBy(boxes.code().alias("box")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k, side: X.lookup(F.col("box"), [float(boxes.bounds(i)[k][side]) for i in range(boxes.n_bins)])
    return n.select(edge(0, 0).alias("low"), edge(0, 1).alias("high"), edge(1, 0).alias("q_low"), edge(1, 1).alias("q_high"), "n")


def marginals_cube(spark: SparkSession, d: str) -> DataFrame:
    """The tables of all sets of three columns, made of the cells of the largest."""
    return M.cube(_coded(spark, d), ["l_returnflag", "l_linestatus", "qty"])


def distinct_columns(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers of values of nine columns, from one job."""
    found = distinct_counts(_t(spark, d, "lineitem"), _COUNTED)
    return spark.createDataFrame(list(found.items()), "name string, n long")


_COUNTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


def generate_from_store(spark: SparkSession, d: str) -> DataFrame:
    """One-way tables that noise-free models of all strategies have after they were stored, loaded and stored again: of
    the marginals' rows, as Spark reads them."""
    rows = _coded(spark, d).persist()
    base, out = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", None
    for strategy, params in (("mst", {}), ("aim", {"rounds": 12}), ("priv-bayes", {})):
        g = GraphicalGenerator(strategy, epsilon=None, compress=False, seed=1, **params).set_domain(SIZES).fit(rows)
        g.store(spark, f"{base}/{strategy}")
        g = GraphicalGenerator.load(spark, f"{base}/{strategy}")
        g.store(spark, f"{base}/{strategy}-again")
        tables = clique_tables(spark.read.parquet(f"{base}/{strategy}-again/values.parquet"), SIZES, g.model.cliques)
        for a in SIZES:
            home = min((c for c in g.model.cliques if a in c), key=SIZES.size)
            own = M.factor_sum(tables[home], [a]).select(F.lit(strategy).alias("strategy"), F.lit(a).alias("a"), F.col(a).alias("code"), F.round("value").cast("long").alias("n"))
            out = own if out is None else out.union(own)
    rows.unpersist()
    return out


def stored_marginal(spark: SparkSession, d: str) -> DataFrame:
    """A marginal of three columns that no clique holds: of a chain of stored pair tables, by joins."""
    counts = M.TableCounts(_coded(spark, d), SIZES)
    chain = [("l_returnflag", "l_linestatus"), ("l_linestatus", "qty"), ("l_linenumber", "qty")]
    model = GraphicalModel(SIZES, chain).fit({c: f.dense() for c, f in counts(chain).items()})
    g = GraphicalGenerator("mst", epsilon=None).set_domain(SIZES)
    g.model = model
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    model.marginals = CliqueVector({c: counts([c])[c].dense() for c in model.cliques})
    spark.createDataFrame(g.values()).write.parquet(path)
    tables = clique_tables(spark.read.parquet(path), SIZES, model.cliques)
    found = table_marginal(tables, model.tree, ["l_returnflag", "l_linenumber", "qty"])
    return found.where("value > 0").withColumn("value", F.round("value", 6))


_WROTE = ("parquet", "orc", "csv", "json", "coded")


def readers_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment and nation, written in each format and read again; "coded" is a CSV of codes with the JSON of
    its domain."""
    t = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    base, out = f"{shared_folder(spark)}/read-{uuid.uuid4().hex}", None
    for kind in _WROTE:
        path = f"{base}/{kind}"
        if kind == "coded":
            t.select(F.col("c_nationkey").alias("nation"), F.lit(0).alias("other")).write.option("header", True).csv(path)
            write_text(spark, f"{base}/domain.json", '{"nation": 25}')
            coded, domain = load_coded(spark, path, f"{base}/domain.json")
            back = coded.where(F.col("nation") < domain["nation"]).select(F.lit(None).cast("string").alias("segment"), "nation", F.lit(0.0).alias("balance"))
        else:
            writer = t.write.format(kind).option("header", True) if kind == "csv" else t.write.format(kind)
            writer.save(path)
            back = read_table(spark, path, kind, t.schema).select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
        own = back.groupBy(F.lit(kind).alias("format"), "segment", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))
        out = own if out is None else out.union(own)
    return out


def binner_from_store(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a whole pipeline's discretisation, and the rows it makes for given flags, after it was stored and loaded."""
    t = _t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).alias("q"), F.lit("same").alias("static"))
    domain = {"l_returnflag": {"categories": FLAGS}, "q": {"lower": 5, "upper": 50}}
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    Pipeline("mst", epsilon=None, n_bins=9, iters=50, seed=3).fit(t, domain=domain, public=True).store(spark, path)
    b = Pipeline.load(spark, path).binner
    coded = b.transform(t)
    return coded.groupBy("l_returnflag", F.when(F.col(b.flags["q"]) == 0, F.col("q")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("static", F.lit(str(b.static["static"])))


def zero_bins(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each quantity bin, and whether structural zeros (two intervals that overlap, and a category) cover it."""
    t = _t(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    b = TableBinner("uniform", 10, domain={"l_returnflag": {"categories": FLAGS}, "l_quantity": {"lower": 0, "upper": 50}}, zeros={"l_quantity": [(14, 20), (10, 15), (41, 44)], "l_returnflag": ["N"]}).fit(t, public=True)
    never = b.impossible()
    n = b.transform(t).groupBy("l_returnflag", F.col("l_quantity").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_returnflag", "bin", "n", (F.col("bin").isin(never["l_quantity"]) | F.col("l_returnflag").isin(never["l_returnflag"])).alias("impossible"))


def intervals_binned(spark: SparkSession, d: str) -> DataFrame:
    """Times of orders since noon of the first of 1992, as intervals, in sixteen bins, with names that are taken."""
    t = _t(spark, d, "orders").select((F.col("o_orderdate") - F.lit("1992-01-01 12:00:00").cast("timestamp_ntz")).alias("since"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"), F.lit(1).alias("price_NaN"), F.lit(2).alias("price_NaN_0"))
    low, high = -12 * 3600 * X.MICROS, 2557 * 86_400 * X.MICROS
    b = TableBinner("uniform", 16, domain={"since": {"lower": low, "upper": high}}).fit(t, public=True)
    coded = b.transform(t)
    flag = b.flags.get("price", "none")
    return coded.groupBy(F.col("since").alias("bin"), F.lit(flag).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag) if flag in coded.columns else F.lit(0)).cast("long").alias("n_null"))


def conditioned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows by condition of a table that was generated for given conditions: as many of each as there were."""
    made = generate_conditional(spark, d)
    return made.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal").isNull() | ~F.col("c_nationkey").between(0, 25)).alias("n_odd"))


def model_projection(spark: SparkSession, d: str) -> DataFrame:
    """A pair that no clique holds: of the junction tree of a chain of pair tables, by parts of the tree."""
    chain = [("l_returnflag", "l_linestatus"), ("l_linestatus", "qty"), ("l_linenumber", "qty")]
    counts = M.TableCounts(_coded(spark, d), SIZES)(chain)
    model = GraphicalModel(SIZES, chain).fit({c: f.dense() for c, f in counts.items()})
    model.total = counts[chain[0]].total
    model.marginals = model.belief_propagation(model.potentials)
    found = model.project_many([("l_returnflag", "l_linenumber")])["l_returnflag", "l_linenumber"].values
    return spark.createDataFrame([(i, j, round(float(found[i, j]), 4)) for i in range(3) for j in range(7)], "l_returnflag int, l_linenumber int, value double")


def aim_first_choice(spark: SparkSession, d: str) -> DataFrame:
    """What noise-free adaptive rounds measure first: the pair that the one-way tables answer worst."""
    chosen = STRATEGIES["aim"](epsilon=None, compress=False, rounds=1).select(SIZES, M.TableCounts(_coded(spark, d), SIZES))
    return spark.createDataFrame([tuple(m.clique) for m in chosen.measurements if len(m.clique) == 2], "a string, b string")


def code_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a coded table that its domain does not fit, by what is said of them."""
    t = _coded(spark, d).select("l_returnflag", "qty", (F.col("l_linenumber") - 1).alias("below"), F.when(F.col("qty") > 0, F.col("qty")).alias("gap"), F.col("qty").cast("double").alias("fraction"))
    said = []
    for a, n in (("l_returnflag", 3), ("qty", 10), ("qty", 5), ("below", 7), ("gap", 10), ("fraction", 10), ("absent", 2)):
        try:
            M.check_codes(t, Domain.of({a: n}))
            said.append((a, n, ""))
        except ValueError as e:
            said.append((a, n, str(e)))
    return spark.createDataFrame(said, "name string, size int, said string")


def fitted(spark: SparkSession, d: str, strategy: str, **params) -> Pipeline:
    """A pipeline fitted to six columns of lineitem under a budget."""
    t = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    domain = {"l_returnflag": {"categories": FLAGS}, "l_linestatus": {"categories": STATUS}, "l_quantity": {"lower": 1, "upper": 50}, "l_discount": {"lower": 0, "upper": 0.1}, "l_tax": {"lower": 0, "upper": 0.08}}
    return Pipeline(strategy, epsilon=1.0, proc_epsilon=0.1, n_bins=10, seed=7, **params).fit(t, domain=domain)


def _generate(strategy: str, **params) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fitted(spark, d, strategy, **params).generate(spark, 1000, seed=7)


def generate_conditional(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p = Pipeline("mst", epsilon=1.0, n_bins=10, seed=7).fit(t, domain={"c_acctbal": {"lower": -1000, "upper": 10000}, "c_nationkey": {"lower": 0, "upper": 25}})
    return p.generate(spark, condition_records=t.select("c_mktsegment"), seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (profile_columns, encode_categories, bin_uniform, bin_optimal_count, bin_privtree_noise_free, bin_inverse_midpoint, marginal_1way, marginal_2way, marginal_3way, marginal_weighted, marginals_all_pairs, marginal_dense, marginal_rollup, marginal_datetime, entropy_1way, mutual_information_pairs, mst_edge_weights, mst_edges_noise_free, compress_supports, compress_transform, null_flag_fill, compress_reverse, binner_round_trip, null_restore, private_bounds_noise_free, factor_product, factor_divide, factor_condition, conditional_distribution, quota_round, generate_rounded, generate_rounded_privbayes, generate_from_json, stream_codes, redrawn_codes, compressed_pairs, compressed_pair_errors, bin_privtree_2d, marginals_cube, distinct_columns, generate_from_store, stored_marginal, readers_round_trip, binner_from_store, zero_bins, intervals_binned, conditioned_rows, model_projection, aim_first_choice, code_bounds, generate_conditional)
    out = {f.__name__: f for f in own} | {"workload_scores": workload_scores_query, "bounds_histogram": bounds_histogram_query}
    return out | {"generate_mst": _generate("mst"), "generate_aim": _generate("aim"), "generate_privbayes": _generate("priv-bayes")}


def oracle_sql() -> dict[str, str]:
    c = f"WITH c AS {_CODED_SQL}"
    pair = f"{c}, p AS (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY ALL), q AS (SELECT l_linestatus, qty, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY ALL)"
    attrs = list(SIZES.attrs)
    grid = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, g.i, h.j, coalesce(x.n, 0) AS n, ra.n AS na, rb.n AS nb FROM range({SIZES[a]}) AS g(i) CROSS JOIN range({SIZES[b]}) AS h(j) LEFT JOIN (SELECT {a} AS i, {b} AS j, count(*) AS n FROM c GROUP BY ALL) x ON x.i = g.i AND x.j = h.j LEFT JOIN (SELECT {a} AS i, count(*) AS n FROM c GROUP BY ALL) ra ON ra.i = g.i LEFT JOIN (SELECT {b} AS j, count(*) AS n FROM c GROUP BY ALL) rb ON rb.j = h.j"
    pairs = list(combinations(attrs, 2))
    entropy = lambda cols: f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*)::DOUBLE FROM c) AS p FROM c GROUP BY {cols}))"
    stats = lambda x: f"SELECT '{x}' AS name, count(*) AS n, count(*) - count({x}) AS n_null, count(DISTINCT {x}) AS n_distinct, count(DISTINCT {x}) + CAST(count(*) > count({x}) AS INT) <= 1 AS static, CAST(min({x}) AS DOUBLE) AS low, CAST(max({x}) AS DOUBLE) AS high FROM lineitem"
    power = lambda x: f"CAST(CASE WHEN abs({x}) < 1 THEN 0 ELSE sign({x}) * (floor(log2(abs({x}))) + 1) END AS INT)"
    edge = lambda b, up: f"CASE WHEN {b} = 0 THEN {up} WHEN {b} > 0 THEN pow(2.0, {b} - {int(up < 0)}) ELSE -pow(2.0, -{b} - {int(up > 0)}) END"
    bounds = lambda x: f"SELECT '{x}' AS name, CAST({edge('min(b)', -1)} AS DOUBLE) AS low, CAST({edge('max(b)', 1)} AS DOUBLE) AS high FROM (SELECT {power(x)} AS b FROM customer)"
    weights = "w AS (SELECT a, b, sum(abs(n - na * nb / (SELECT count(*)::DOUBLE FROM c))) AS w FROM (" + " UNION ALL ".join(grid(a, b) for a, b in pairs) + ") GROUP BY a, b)"
    ones = f"{c} " + " UNION ALL ".join(f"SELECT '{a}' AS a, {a} AS code, count(*) AS n FROM c GROUP BY ALL" for a in attrs)
    compress = "y AS (SELECT l_linenumber AS k, count(*) AS n FROM c GROUP BY ALL), kept AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS code FROM y WHERE n >= (SELECT count(*) / 7.0 FROM c))"
    tree = "WITH RECURSIVE nodes AS (SELECT 0.0::DOUBLE AS low, 131072.0::DOUBLE AS high, (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT s.low, s.high, (SELECT count(*) FROM lineitem l WHERE l.l_extendedprice >= s.low AND l.l_extendedprice < s.high) AS n FROM (SELECT CASE k WHEN 0 THEN low ELSE (low + high) / 2 END AS low, CASE k WHEN 0 THEN (low + high) / 2 ELSE high END AS high FROM nodes, (VALUES (0), (1)) v(k) WHERE n > (SELECT count(*) / 64.0 FROM lineitem)) s)"
    rare = "WITH r AS (SELECT CAST(l_linenumber - 1 AS INT) AS l_linenumber, CAST(l_quantity AS INT) - 1 AS quantity, CAST(round(l_discount * 100) AS INT) AS discount FROM lineitem)"
    kept = lambda a: f"k_{a} AS (SELECT {a}, CAST(row_number() OVER (ORDER BY {a}) - 1 AS INT) AS code FROM (SELECT {a}, count(*) AS n FROM r GROUP BY ALL) WHERE n >= (SELECT count(*) / {RARE[a]}.0 FROM r))"
    small = "s AS (SELECT " + ", ".join(f"coalesce(k_{a}.code, (SELECT count(*) FROM k_{a}))::INT AS {a}" for a in RARE) + " FROM r " + " ".join(f"LEFT JOIN k_{a} USING ({a})" for a in RARE) + ")"
    rare = f"{rare}, {', '.join(map(kept, RARE))}, {small}"
    rare_pairs = list(combinations(RARE.attrs, 2))
    off = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, round(sum(abs(coalesce(n, 0) - x.n1 * y.n1 / (SELECT count(*)::DOUBLE FROM s))), 3) AS w FROM (SELECT {a}, count(*) AS n1 FROM s GROUP BY ALL) x CROSS JOIN (SELECT {b}, count(*) AS n1 FROM s GROUP BY ALL) y LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM s GROUP BY ALL) z USING ({a}, {b})"
    boxes = """WITH RECURSIVE nodes AS (
      SELECT 0.0::DOUBLE AS low, 131072.0::DOUBLE AS high, 0.0::DOUBLE AS q_low, 64.0::DOUBLE AS q_high, (SELECT count(*) FROM lineitem) AS n
      UNION ALL SELECT s.low, s.high, s.q_low, s.q_high, (SELECT count(*) FROM lineitem l WHERE l.l_extendedprice >= s.low AND l.l_extendedprice < s.high AND l.l_quantity >= s.q_low AND l.l_quantity < s.q_high) AS n
      FROM (SELECT CASE a WHEN 0 THEN low ELSE (low + high) / 2 END AS low, CASE a WHEN 0 THEN (low + high) / 2 ELSE high END AS high, CASE b WHEN 0 THEN q_low ELSE (q_low + q_high) / 2 END AS q_low, CASE b WHEN 0 THEN (q_low + q_high) / 2 ELSE q_high END AS q_high
        FROM nodes, (VALUES (0), (1)) v(a), (VALUES (0), (1)) w(b) WHERE n > (SELECT count(*) / 64.0 FROM lineitem)) s)"""
    plain = " UNION ALL ".join(f"SELECT '{k}' AS format, c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL" for k in _WROTE if k != "coded")
    return {
        "readers_round_trip": f"{plain} UNION ALL SELECT 'coded', NULL, c_nationkey, count(*), 0.0 FROM customer WHERE c_nationkey < 25 GROUP BY ALL",
        "binner_from_store": "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag, CASE WHEN l_quantity >= 5 THEN CAST(least(floor((l_quantity - 5) / 5), 8) AS INT) END AS bin, count(*) AS n, 'same' AS static FROM lineitem GROUP BY ALL",
        "zero_bins": "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag, CAST(least(floor(l_quantity / 5), 9) AS INT) AS bin, count(*) AS n, (bin IN (2, 3)) OR l_returnflag = 'N' AS impossible FROM lineitem GROUP BY ALL",
        "intervals_binned": "SELECT CAST(least(greatest(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01 12:00:00') + 43200000000) / ((2557 * 86400000000 + 43200000000) / 16.0)), 0), 15) AS INT) AS bin, CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice <= 1000) > 0 THEN 'price_NaN_1' ELSE 'none' END AS flag, count(*) AS n, count(*) FILTER (o_totalprice <= 1000) AS n_null FROM orders GROUP BY ALL",
        "conditioned_rows": "SELECT c_mktsegment, count(*) AS n, 0::BIGINT AS n_odd FROM customer GROUP BY ALL",
        "model_projection": f"{c}, fs AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM c GROUP BY ALL), sq AS (SELECT l_linestatus, qty, count(*) AS n FROM c GROUP BY ALL), lq AS (SELECT l_linenumber, qty, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT l_linestatus, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT qty, count(*) AS n FROM c GROUP BY ALL) SELECT l_returnflag, l_linenumber, round(sum(fs.n * sq.n / s.n::DOUBLE * lq.n / q.n), 4) AS value FROM fs JOIN sq USING (l_linestatus) JOIN s USING (l_linestatus) JOIN lq USING (qty) JOIN q USING (qty) GROUP BY ALL",
        "aim_first_choice": f"{c}, {weights} SELECT a, b FROM w ORDER BY w DESC LIMIT 1",
        "code_bounds": f"{c}, t AS (SELECT l_returnflag, qty, l_linenumber - 1 AS below, CASE WHEN qty > 0 THEN qty END AS gap FROM c) SELECT name, CAST(size AS INT) AS size, CASE WHEN name = 'absent' THEN 'column absent is missing' WHEN name = 'fraction' THEN 'column fraction must hold integers, not double' WHEN n_null > 0 THEN 'column ' || name || ' holds nulls' WHEN low < 0 OR high >= size THEN 'column ' || name || ' holds codes outside 0..' || (size - 1) ELSE '' END AS said FROM (VALUES ('l_returnflag', 3), ('qty', 10), ('qty', 5), ('below', 7), ('gap', 10), ('fraction', 10), ('absent', 2)) v(name, size) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{x}' AS name, min({x}) AS low, max({x}) AS high, count(*) - count({x}) AS n_null FROM t" for x in ("l_returnflag", "qty", "below", "gap")) + ") USING (name)",
        "compressed_pairs": f"{rare} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS i, {b} AS j, count(*) AS n FROM s GROUP BY ALL" for a, b in rare_pairs),
        "compressed_pair_errors": f"{rare} " + " UNION ALL ".join(off(a, b) for a, b in rare_pairs),
        "bin_privtree_2d": f"{boxes} SELECT low, high, q_low, q_high, n FROM nodes WHERE n > 0 AND n <= (SELECT count(*) / 64.0 FROM lineitem)",
        "marginals_cube": f"{c} SELECT l_returnflag, l_linestatus, qty, grouping(l_returnflag, l_linestatus, qty) AS level, count(*) AS n FROM c GROUP BY CUBE (l_returnflag, l_linestatus, qty)",
        "distinct_columns": " UNION ALL ".join(f"SELECT '{x}' AS name, count(DISTINCT {x}) AS n FROM lineitem" for x in _COUNTED),
        "generate_from_store": f"{c} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, '{a}' AS a, v.i::INT AS code, (SELECT count(*) FROM c WHERE {a} = v.i) AS n FROM range({SIZES[a]}) v(i)" for s in ("mst", "aim", "priv-bayes") for a in attrs),
        "stored_marginal": f"{c}, fs AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM c GROUP BY ALL), sq AS (SELECT l_linestatus, qty, count(*) AS n FROM c GROUP BY ALL), lq AS (SELECT l_linenumber, qty, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT l_linestatus, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT qty, count(*) AS n FROM c GROUP BY ALL) SELECT l_returnflag, l_linenumber, qty, round(sum(fs.n * sq.n / s.n::DOUBLE * lq.n / q.n), 6) AS value FROM fs JOIN sq USING (l_linestatus) JOIN s USING (l_linestatus) JOIN lq USING (qty) JOIN q USING (qty) GROUP BY ALL",
        "profile_columns": " UNION ALL ".join(map(stats, ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))),
        "encode_categories": "SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)",
        "bin_uniform": f"{c} SELECT qty, count(*) AS n FROM c GROUP BY ALL",
        "bin_optimal_count": "SELECT CAST(ceil(round(2 * pow(count(*), 1.0 / 3), 9)) AS INT) AS n_bins FROM lineitem",
        "bin_privtree_noise_free": f"{tree} SELECT low, high, n FROM nodes WHERE n > 0 AND n <= (SELECT count(*) / 64.0 FROM lineitem)",
        "bin_inverse_midpoint": f"{c} SELECT qty, 0.5 + 5.0 * qty + 2.5 AS mid, count(*) AS n FROM c GROUP BY ALL",
        "marginal_1way": f"{c} SELECT l_returnflag, count(*) AS n FROM c GROUP BY ALL",
        "marginal_2way": f"{c} SELECT l_returnflag, qty, count(*) AS n FROM c GROUP BY ALL",
        "marginal_3way": f"{c} SELECT l_returnflag, l_linestatus, qty, count(*) AS n FROM c GROUP BY ALL",
        "marginal_weighted": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS w FROM lineitem GROUP BY ALL",
        "marginals_all_pairs": f"{c} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS i, {b} AS j, count(*) AS n FROM c GROUP BY ALL" for a, b in pairs),
        "marginal_dense": f"{c} SELECT CAST(f.i AS INT) AS l_returnflag, CAST(s.i AS INT) AS l_linestatus, CAST(q.i AS INT) AS qty, count(c.qty) AS n FROM range(3) f(i) CROSS JOIN range(2) s(i) CROSS JOIN range(10) q(i) LEFT JOIN c ON c.l_returnflag = f.i AND c.l_linestatus = s.i AND c.qty = q.i GROUP BY ALL",
        "marginal_rollup": f"{c} SELECT qty, count(*) AS n FROM c GROUP BY ALL",
        "marginal_datetime": "SELECT CAST(least(greatest(floor((epoch_us(o_orderdate) - 694224000000000) / 12623040000000.0), 0), 19) AS INT) AS bin, count(*) AS n FROM orders GROUP BY ALL",
        "bounds_histogram": " UNION ALL ".join(f"SELECT '{x}' AS name, {power(x)} AS bin, count(*) AS n FROM customer GROUP BY ALL" for x in _BALANCE),
        "private_bounds_noise_free": " UNION ALL ".join(map(bounds, _BALANCE)),
        "entropy_1way": f"{c} " + " UNION ALL ".join(f"SELECT '{a}' AS a, round({entropy(a)}, 6) AS h" for a in attrs),
        "mutual_information_pairs": f"{c} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(({entropy(a)} + {entropy(b)} - {entropy(f'{a}, {b}')}) / sqrt({entropy(a)} * {entropy(b)}), 6) AS mi" for a, b in pairs),
        "mst_edge_weights": f"{c}, {weights} SELECT a, b, round(w, 1) AS w FROM w",
        "mst_edges_noise_free": f"{c}, {weights}, t AS (SELECT [x, y, z] AS es FROM w x, w y, w z WHERE (x.a, x.b) < (y.a, y.b) AND (y.a, y.b) < (z.a, z.b) AND len(list_distinct([x.a, x.b, y.a, y.b, z.a, z.b])) = 4 ORDER BY x.w + y.w + z.w DESC LIMIT 1) SELECT e.a AS a, e.b AS b FROM (SELECT unnest(es) AS e FROM t)",
        "workload_scores": f"{c} " + " UNION ALL ".join(f"SELECT '{'+'.join(sorted(w))}' AS clique, CAST({k} AS INT) AS score, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(w)} FROM c)) AS n_cells, (SELECT count(*) FROM c) AS n" for w, k in ((("l_returnflag",), 1), (("l_linestatus",), 2), (("qty",), 2), (("l_linenumber",), 1), (("l_returnflag", "l_linestatus"), 3), (("l_linestatus", "qty"), 4), (("l_linenumber", "qty"), 3))),
        "compress_supports": f"{c}, {compress} SELECT k AS code FROM kept",
        "compress_transform": f"{c}, {compress} SELECT coalesce(kept.code, (SELECT count(*) FROM kept))::INT AS code, count(*) AS n FROM c LEFT JOIN kept ON kept.k = c.l_linenumber GROUP BY ALL",
        "compress_reverse": f"{c}, {compress} SELECT CASE WHEN kept.k IS NULL THEN -1 ELSE kept.k END AS code, count(*) AS n FROM c LEFT JOIN kept ON kept.k = c.l_linenumber GROUP BY ALL",
        "binner_round_trip": "SELECT l_returnflag, CAST(least(floor((CASE WHEN l_quantity >= 5 THEN l_quantity END - 5) / 5), 8) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL",
        "null_restore": "SELECT count(*) FILTER (l_quantity < 5) AS n_null, count(*) FILTER (l_quantity >= 5) AS n FROM lineitem",
        "null_flag_fill": "SELECT CASE WHEN l_quantity >= 5 THEN 0 ELSE 1 END AS flag, count(*) AS n, 0::BIGINT AS n_null FROM lineitem GROUP BY ALL",
        "factor_product": f"{pair} SELECT l_linestatus, l_returnflag, qty, p.value * q.value AS value FROM p JOIN q USING (l_linestatus)",
        "factor_divide": f"{pair} SELECT l_returnflag, l_linestatus, round(p.value / s.v, 9) AS value FROM p JOIN (SELECT l_linestatus, sum(value) AS v FROM q GROUP BY ALL) s USING (l_linestatus)",
        "factor_condition": f"{pair} SELECT qty, value FROM q WHERE l_linestatus = 1",
        "conditional_distribution": f"{pair} SELECT l_returnflag, l_linestatus, round(value / sum(value) OVER (PARTITION BY l_linestatus), 9) AS value FROM p",
        "quota_round": f"{c} SELECT l_linestatus, CAST(dense_rank() OVER (PARTITION BY l_linestatus ORDER BY l_returnflag) - 1 AS INT) AS nth, count(*) AS n FROM c GROUP BY l_linestatus, l_returnflag",
        "generate_rounded": ones,
        "generate_rounded_privbayes": ones,
        "generate_from_json": ones,
        "stream_codes": "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag, CAST(least(floor(l_quantity / 5), 9) AS INT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL",
        "redrawn_codes": f"{c} SELECT k.i::INT AS code, (SELECT count(*) FROM c WHERE l_linenumber = k.i) AS n, round((SELECT count(*) FROM c WHERE l_linenumber > 2) / 3.0 / (SELECT count(*) FROM c WHERE l_linenumber > 2), 1)::DOUBLE AS share FROM range(3) k(i)",
    }
