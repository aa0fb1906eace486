"""Persistent tables in a folder that all executors see: bucketed and sorted by a key, so that lookups read few files."""
from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all tasks run in this machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return (base or "file://" + tempfile.mkdtemp(prefix="lodestack-")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to as many tasks as shuffles have: for work that costs far more than the bytes of its rows tell, which a scan
    of a small file would leave to one task and adaptive joining of partitions to a few."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, *by)


class Bucketed:
    """Parquet files under path, bucketed and sorted by key; the same path gives the same table in a later session.

    schema is DDL; parts are columns of it that folders are named by. The number of buckets is that of the first use, so
    give the same one again. Writers deal a key's rows to `spread` tasks by the hash of another column,
    so a key that holds a third of all rows is no single task's work, and a bucket has that many files for each append.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int, parts: Sequence[str] = ()):
        self.spark, self.path, self.key, self.buckets, self.parts = spark, path, key, buckets, list(parts)
        self.name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        by = f"PARTITIONED BY ({', '.join(parts)})" if parts else ""
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet {by} CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
            fs, p = _file_system(spark, path)
            fs.mkdirs(p)
            if parts:
                spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def append(self, rows: DataFrame, spread_by: str | Column | None = None, spread: int = 1, same: dict[str, Column] | None = None) -> None:
        """same: columns with one value in all rows, which are not shuffled."""
        salt = [F.pmod(F.xxhash64(spread_by), F.lit(spread))] if spread_by is not None and spread > 1 else []
        columns = self.spark.table(self.name).columns
        if salt:
            # by number, since hashes of so few pairs would meet: some tasks would have several, others none
            rows = rows.repartitionById(self.buckets * spread, (F.pmod(F.hash(self.key), F.lit(self.buckets)) * spread + salt[0]).cast("int"))
        else:
            rows = rows.repartition(self.buckets, self.key)
        rows = rows.withColumns(same or {})
        if self.parts:
            rows = rows.sortWithinPartitions(*self.parts, self.key)
        rows.select(*columns).write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)  # rows of another session, as in a stream's batch, don't tell this one

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def among(self, values: Sequence[object]) -> DataFrame:
        """Rows of a few keys: only their buckets are read."""
        return self.read().where(F.col(self.key).isin(list(values)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in keys (a column named like this table's). The files are joined as they lie: only keys are shuffled."""
        return self.read().join(keys.select(self.key).distinct().hint("merge"), self.key, "left_semi")

    def drop(self) -> None:
        """The table's entry in the session's catalogue and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_folder(self.spark, self.path)
