"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; the result
is written as Parquet and read again as the next one's docs. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, lines, quality, queries, simhash
from marginalia.llm.common import free_name, remove, shared_folder, small_side, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of docs outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(queries.fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(quality.sample(docs, labels))
    score = free_name(docs.columns, "score")
    return quality.scores(docs, model, score=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat earlier ones; n_chars follows the text."""
    n_lines, n_removed = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_removed")
    out = lines.dedup(docs, n_lines=n_lines, n_removed=n_removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(n_lines, n_removed)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the
    one with the smallest doc_id.

    Documents without any word (the line stage empties exact copies) form one group like any other.
    """
    # what goes is the smaller part: its ids are broadcast up to a checked number, and texts stay where they are
    found = simhash.similar(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = free_name(docs.columns, "gone")
    dropped = small_side(found.where(~F.col("stays")).select(F.col("doc_id").alias(gone)))
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped[gone]), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    done = bpe.encode(docs, public_tokenizers.path(queries.VOCABULARY), decode=False)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding", token_stage),
]

#: Classifier, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written to the shared folder and read again.

    What a stage has read goes once its own rows are written; the last rows stay, for the result.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
