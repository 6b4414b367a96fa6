"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts are long, so batches are kept short.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Also sets the Arrow batch size that the Python stages rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's own. Where both are unset one is made if the
    executors are threads of this machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Hadoop knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def by_group(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``fn`` on runs of whole groups of ``key`` (a long), many small groups at a time.

    Rows are dealt by key and sorted; a task streams over its part and hands ``fn`` an Arrow
    table that begins and ends at group borders. Only one group has to fit into memory: callers
    bound its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            same = bool(held) and held[-1].column(0)[-1].as_py() == keys[0]
            if cut == 0 and (same or not held):
                held.append(batch)
                continue
            yield from fn(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from fn(pa.Table.from_batches(held))

    columns = [key, *(c for c in df.columns if c != key)]
    return df.select(columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


#: Rows of a few numbers that are broadcast at most.
ROWS_BROADCAST = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """The rows of df, for a join: they are counted, and broadcast if they are ROWS_BROADCAST at most."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= ROWS_BROADCAST else df


#: Buckets that hot_keys counts first: the most rows that one of its tasks sends.
BUCKETS = 1 << 18


def hot_keys(df: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, _n) of the values of ``key`` (a well mixed long) that over ``cap`` rows have.

    Rows are counted by bucket of their key first, which a task sums up before it sends, so that most
    keys, which are rare, are never moved for their count.
    """
    bucket = F.pmod(F.shiftright(F.col(key), 20), F.lit(BUCKETS)).cast("int")
    full = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > cap).select("_b")
    within = df.select(key, bucket.alias("_b")).join(F.broadcast(full), "_b", "left_semi")  # BUCKETS rows at most
    return small_side(within.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap))


def hot_pairs(df: DataFrame, key: str, node: str, cap: int) -> DataFrame:
    """Bound the groups of ``key``: a group of over ``cap`` rows is cut into chunks by a hash of
    ``node``, and each row goes to every pair of chunks that its own chunk is in. Adds the columns
    chunk, lo and hi and replaces the key by one of the (group, lo, hi); all pairs of rows still
    meet in some group of 2 * cap rows or so.
    """
    k = F.coalesce(F.ceil(F.col("_n") / F.lit(float(cap))).cast("int"), F.lit(1))
    return (
        df.join(hot_keys(df, key, cap), key, "left")
        .withColumn("_k", k)
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(17), F.col(node)), F.col("_k")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("lo", F.least("chunk", "_j"))
        .withColumn("hi", F.greatest("chunk", "_j"))
        .withColumn(key, F.when(F.col("_k") == 1, F.col(key)).otherwise(F.xxhash64(key, "lo", "hi")))
        .drop("_n", "_k", "_j")
    )


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the given pairs (min-label with pointer jumping)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id that each node of edges (a, b) reaches.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"); each round's edges are checkpointed. Empty edges give no rows.
    """
    edges = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = checkpoint(small.select("e.*").where("a <> b").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return tuple(row)
