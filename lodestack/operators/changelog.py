"""A keyed store as a log of changes: appended, merged when read, compacted into snapshots."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.tables import Bucketed, remove_folder


class ChangeLog:
    """Rows of schema (DDL) by a unique key, under path. One writer at a time.

    Each call of put, delete or compact is a commit with the next sequence number. It counts once its row in `commits` is
    there, so a call that broke off changes nothing. A read joins the last snapshot (bucketed by key, not shuffled) with the changes
    after it; compact writes a snapshot of what a read gives. Null keys are refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key = spark, path, key
        self.changes = Bucketed(spark, f"{path}/changes", f"{schema}, _deleted boolean, _seq bigint", key, buckets)
        self.snapshots = Bucketed(spark, f"{path}/snapshots", f"{schema}, _seq bigint", key, buckets, ("_seq",))
        self.commits = Bucketed(spark, f"{path}/commits", "seq bigint, kind string, n bigint", "seq", 1)
        self.columns = [c for c in self.changes.read().columns if not c.startswith("_")]

    def _known(self, at: int | None = None) -> tuple[int, int, list[int]]:
        """Last sequence number, that of the snapshot to read (-1: none), and those of the changes after it."""
        rows = sorted((r["seq"], r["kind"]) for r in self.commits.read().collect() if at is None or r["seq"] <= at)
        base = max((s for s, k in rows if k == "snapshot"), default=-1)
        return max((s for s, _ in rows), default=-1), base, [s for s, k in rows if k != "snapshot" and s > base]

    def _commit(self, seq: int, kind: str, n: int) -> None:
        self.commits.append(self.spark.range(1).select(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("n")))

    def _append(self, rows: DataFrame, deleted: bool) -> int:
        seq = self._known()[0] + 1
        whole = rows.where(F.col(self.key).isNotNull()).withColumns({"_deleted": F.lit(deleted), "_seq": F.lit(seq).cast("bigint")})
        self.changes.append(whole)
        n = self.changes.read().where(F.col("_seq") == seq).count()
        self._commit(seq, "delete" if deleted else "put", n)
        return n

    def put(self, rows: DataFrame, order: Column | None = None) -> int:
        """Insert or replace; of rows with one key the last by order stays (by all columns, without one). Returns how many keys were put."""
        by = F.struct(*[c for c in (self.columns if order is None else [])]) if order is None else order
        value = F.struct(*self.columns)
        last = rows.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(value, by).alias("_v")).select("_v.*")
        return self._append(last, False)

    def put_new(self, rows: DataFrame) -> DataFrame:
        """Insert rows whose key is not there; returns (key, status): added or E_ALREADY_EXISTS, a row for each row given. Of rows with one key the least is added."""
        before = self._known()[0]
        there = self.read(before).select(self.key)
        new = rows.join(there.hint("merge"), self.key, "left_anti")
        value = F.struct(*self.columns)
        self._append(new.groupBy(F.col(self.key).alias("_k")).agg(F.min(value).alias("_v")).select("_v.*"), False)
        added = self.changes.read().where(F.col("_seq") == before + 1).select(F.struct(*self.columns).alias("_v"), F.col(self.key).alias("_k"))
        out = rows.select(self.key, value.alias("_given")).join(added, F.col(self.key) == F.col("_k"), "left")
        # of rows repeated in full one was added, the others found it
        copies = out.groupBy(self.key, "_given", F.col("_given").eqNullSafe(F.col("_v")).alias("_same")).agg(F.count(F.lit(1)).alias("_n"))
        status = F.transform(F.sequence(F.lit(1).cast("long"), "_n"), lambda i: F.when(F.col("_same") & (i == 1), "added").otherwise("E_ALREADY_EXISTS"))
        return copies.select(self.key, F.explode(status).alias("status"))

    def update(self, changes: DataFrame, columns: Sequence[str]) -> int:
        """Set columns of the keys in changes (unique there); keys that are not there are passed over."""
        new = changes.select(self.key, *[F.col(c).alias(f"_{c}") for c in columns])
        rows = self.read().join(new, self.key)
        return self._append(rows.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in self.columns]), False)

    def delete(self, keys: DataFrame) -> int:
        """Take keys out; returns how many were there."""
        gone = self.read().join(keys.select(self.key).distinct().hint("merge"), self.key, "left_semi")
        return self._append(gone, True)

    def read(self, at: int | None = None) -> DataFrame:
        """The rows after the commit `at`, by default the last."""
        _, base, after = self._known(at)
        rows = self.snapshots.read().where(F.col("_seq") == base).select(*self.columns)
        if not after:
            return rows
        changes = self.changes.read().where(F.col("_seq").isin(after))
        last = changes.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(F.struct(*self.columns, "_deleted"), "_seq").alias("_v"))
        old = rows.join(last.select(F.col("_k").alias(self.key)).hint("merge"), self.key, "left_anti").select(*self.columns)
        return old.unionByName(last.where("NOT _v._deleted").select("_v.*").select(*self.columns))

    def among(self, keys: Sequence[object]) -> DataFrame:
        """The rows of a few keys: only their buckets are read, of the snapshot and of the changes."""
        return self.read().where(F.col(self.key).isin(list(keys)))

    def compact(self) -> int:
        """Write a snapshot of all rows; returns how many."""
        seq = self._known()[0] + 1
        self.snapshots.append(self.read().withColumn("_seq", F.lit(seq).cast("bigint")))
        n = self.snapshots.read().where(F.col("_seq") == seq).count()
        self._commit(seq, "snapshot", n)
        return n

    def drop(self) -> None:
        for t in (self.changes, self.snapshots, self.commits):
            t.drop()
        remove_folder(self.spark, self.path)
