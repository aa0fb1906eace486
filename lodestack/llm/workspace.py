"""Shared-folder tables that cut lineage, and joins against a hot-keyed side."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and all tasks run in this machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """Parquet tables in the shared folder, under a name that no other run has."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back: later stages neither repeat its work nor lose it with an executor."""
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(conf).delete(p, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate: for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(spark: SparkSession, total: float, per_bucket: int = 4 << 20) -> int:
    """Buckets for an exchange of total bytes."""
    return int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // per_bucket), 1_000_000))


def bucket_count(df: DataFrame, text_col: str, per_bucket: int = 4 << 20) -> int:
    """Buckets for an exchange in proportion to the bytes of df; where the optimizer can't tell those, its texts are measured."""
    size = estimated_bytes(df)
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return buckets_for(df.sparkSession, size, per_bucket)


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, row_id: str) -> DataFrame:
    """Left join rows with table (unique by key; weight: rows per key), without one task per hot key.

    Keys with a thousandth of all rows or more are at most 1000, whatever the input: they are broadcast.
    The others join by sort and merge; rows of hot keys get a key of their own there, so they spread.
    """
    values = [c for c in table.columns if c != key]
    share = max(1, total // 1000)
    hot = table.where(F.col(weight) >= share).select(F.col(key).alias("_hot"), F.struct(*values).alias("_h"))
    cold = table.where(F.col(weight) < share).select(F.col(key).alias("_cold"), F.struct(*values).alias("_c"))
    spread = F.unhex(F.sha2(F.concat_ws(":", F.hex(F.col(key)), F.col(row_id).cast("string")), 256))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_k", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    out = out.join(cold.hint("merge"), F.col("_k") == F.col("_cold"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c) for c in values])
