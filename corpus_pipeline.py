"""A training-data pipeline over documents: each stage applies one operator to all that the stage before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
Rows are told apart by doc_id (exact dedup: and text). A null doc_id is an id like any other there; of rows
repeated in full one stays.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, exact_dedup, jaccard_join, line_crf, packing
from lodestack.llm.queries import TOKENIZER
from lodestack.llm.workspace import Workspace

#: A document is rejected below this probability of being good.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Without labels none is rejected."""
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, field, name="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of texts that are equal but for the case of A-Z."""
    index = exact_dedup.DigestIndex(spark)
    found = Workspace(spark, "pipeline-exact").save(exact_dedup.dedup(docs, index), "found")
    index.drop()  # it served this table alone
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__kept"))
    rows = docs.withColumn("__digest", F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)))
    rows = rows.join(kept, (F.col("__digest") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    if found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).count() > kept.count():
        rows = rows.dropDuplicates(["doc_id", "__digest"])  # rows repeated in full
    return rows.select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest doc_id, of each group linked by five-word shingles of similarity 0.8 or more."""
    classes = jaccard_join.similarity_classes(docs, k=5, num=8, den=10)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=10)
    kept = found.where(F.size("hit") == 0).select(F.col("doc_id").alias("__id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, TOKENIZER, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean),
    ("best-fit packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each one's rows written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
