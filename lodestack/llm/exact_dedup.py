"""Exact dedup on a persistent digest index, bucketed and sorted by hash.

DataFrame functions only. Texts are equal when identical after lower-casing A-Z; their identity is the
SHA-256 of the normalised text. The index is a table of one row per distinct text, bucketed by digest
with one sorted file per bucket and append, so the sort-merge anti-join that finds new digests shuffles
the new data only. Null text counts as empty; a null id loses against any other; repeated rows count in
group_size. An empty table gives an empty result.
"""
from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.workspace import Workspace, attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased; null is empty. lower() does just that where all is ASCII, and is faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


class DigestIndex:
    """Persistent table (digest, keep_id, added_by) in the session's warehouse. An index that exists keeps its number of buckets."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.exists():
            about = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            self.buckets = int(about["Num Buckets"])

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups (digest, keep_id) whose digest the index has not, as added by batch."""
        if self.exists():
            known = self.table().select("digest")
            groups = groups.join(known.hint("merge"), "digest", "left_anti")
        (
            groups.select("digest", "keep_id", F.lit(batch).alias("added_by"))
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, index: DigestIndex, cuts: Sequence[object] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as (id_col, digest, keep_id, group_size, kept), after adding its texts to index.

    Docs are taken in batches, by ranges of ids between cuts, the largest ids first (null ids with the smallest). Of
    equal texts the row with the largest id stays, unless an earlier call indexed that text: then all rows here go, and
    keep_id is the indexed one. Of rows repeated in full one stays. keep_id and kept are what the index says.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact-dedup")
    digests = ws.save(
        docs.select(
            F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    batches, bounds = [], [None, *sorted(cuts, reverse=True), None]
    for upper, lower in itertools.pairwise(bounds):
        rows = digests
        if upper is not None:
            rows = rows.where(F.coalesce(F.col("_id") < upper, F.lit(True)))
        if lower is not None:
            rows = rows.where(F.col("_id") >= lower)
        batches.append(uuid.uuid4().hex)
        index.add(rows.groupBy("digest").agg(F.max("_id").alias("keep_id")), batches[-1])
    here = F.col("added_by").isin(batches)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("_row", "_id"), F.max("_row")).alias("_keep_row"))
    found = index.table().select("digest", "keep_id", F.when(here, True).otherwise(False).alias("_here"))
    groups = ws.save(sizes.join(found.hint("merge"), "digest"), "groups")
    out = attach(digests, groups, "digest", "group_size", digests.count(), "_row")
    return out.select(F.col("_id").alias(id_col), "digest", "keep_id", "group_size", (F.col("_here") & (F.col("_row") == F.col("_keep_row"))).alias("kept"))
