"""Incremental scans of a tree of files: only paths that are new or changed since the last scan are read and hashed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.changelog import ChangeLog

#: (path, modified, length, digest) by path.
INDEX = "path string, modified timestamp, length bigint, digest string"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_index(spark: SparkSession, path: str, buckets: int = 16) -> ChangeLog:
    return ChangeLog(spark, path, INDEX, "path", buckets)


def _hashed(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("digest"))


def follow(spark: SparkSession, root: str, index: ChangeLog, checkpoint: str, per_batch: int = 10_000) -> StreamingQuery:
    """Index files that appeared below root since the checkpoint, all that are there now, at most per_batch in a micro-batch.

    The stream remembers paths, so it is for trees in which files are added and not rewritten; rescan sees changes too. A micro-batch that
    is run again after a failure puts the same rows, which changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    return _hashed(files).writeStream.foreachBatch(lambda rows, _: index.put(rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescan(spark: SparkSession, root: str, index: ChangeLog) -> dict[str, int]:
    """Bring the index up to date with the tree: {"read": files hashed, "removed": paths gone}.

    Files are listed without their contents; of those whose time or length is not the index's, and of no others,
    contents are read: the reader passes over files older than the oldest of them.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = every.select("path", F.col("modificationTime").alias("modified"), "length")
    known = index.read().select("path", "modified", F.col("length"))
    new = listed.join(known, ["path", "modified", "length"], "left_anti")
    oldest, n = new.agg(F.min("modified"), F.count(F.lit(1))).first()
    if n:
        index.put(_hashed(every.where(F.col("modificationTime") >= F.lit(oldest)).join(new.select("path"), "path", "left_semi")))
    return {"read": n, "removed": index.delete(index.read().join(listed, "path", "left_anti"))}


def skills(index: ChangeLog, root: str) -> DataFrame:
    """(namespace, name, version, digest) of files at skills/namespace/name/version/SKILL.md below root."""
    pattern = r"/skills/([^/]+)/([^/]+)/([^/]+)/SKILL\.md$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = index.read().where(F.col("path").rlike(pattern) & F.contains(F.col("path"), F.lit(root.split("://")[-1].rstrip("/"))))
    return rows.select(part(1).alias("namespace"), part(2).alias("name"), part(3).alias("version"), "digest")
