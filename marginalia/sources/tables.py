"""Reading tables and coded datasets, and storing fitted pipelines as JSON through Spark's file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.expressions import uniform
from marginalia.types import Domain


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json, or the name of a table."""
    if kind == "table":
        return spark.table(path)
    reader = spark.read.format(kind).options(**({"header": True} | options if kind == "csv" else options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_coded(spark: SparkSession, path: str, domain_path: str) -> tuple[DataFrame, Domain]:
    """A CSV of codes with the JSON of its domain ({attribute: size})."""
    domain = Domain.of(json.loads(read_text(spark, domain_path)))
    names = read_text_head(spark, path).split(",")
    schema = T.StructType([T.StructField(n.strip().strip('"'), T.IntegerType()) for n in names])
    return read_table(spark, path, "csv", schema).select(*[F.col(f"`{a}`") for a in domain]), domain


def synthetic_codes(spark: SparkSession, domain: Domain, rows: int, seed: int = 0) -> DataFrame:
    """Uniform random codes for every attribute."""
    ids = spark.range(rows)
    return ids.select(*[F.floor(uniform(seed, a, "id") * domain[a]).cast("int").alias(a) for a in domain])


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file at any path that Hadoop's file systems know."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def read_text_head(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()["value"]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)
