"""Versions over time: validity intervals, as-of joins, numbered listings, and provenance by run and cycle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def intervals(versions: DataFrame, key: str, at: str) -> DataFrame:
    """versions with valid_to: when the key's next version begins, null for the last. Versions of one time are valid for no time but the last of them."""
    values = [F.col(c) for c in versions.columns if c not in (key, at)]
    return versions.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(at, *values)))


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, value: Sequence[str], version_at: str | None = None, part: str = "day") -> DataFrame:
    """rows with the columns `value` of the key's version that is valid at each row's time: the latest one not after it, of one time the largest.

    Times are parted (by day, hour, ...), and rows and versions are laid together within a key and part only; what was valid when a part
    began comes from the last versions of the parts before it. So a key that holds most rows is spread over its parts.
    Null where no version is valid yet, or the key or time is null.
    """
    version_at = version_at or at
    fields = F.struct(F.col(version_at).alias("_since"), *value)
    known = versions.where(F.col(key).isNotNull() & F.col(version_at).isNotNull()).select(F.col(key).alias("_k"), F.date_trunc(part, version_at).alias("_p"), F.col(version_at).alias("_t"), fields.alias("_v"))
    mine = rows.select(F.col(key).alias("_k"), F.date_trunc(part, at).alias("_p"), F.col(at).alias("_t"), F.struct(*rows.columns).alias("_row"))
    none = known.select("_v").schema["_v"].dataType
    both = mine.withColumn("_v", F.lit(None).cast(none)).withColumn("_is", F.lit(1)).unionByName(known.withColumn("_row", F.lit(None).cast(mine.schema["_row"].dataType)).withColumn("_is", F.lit(0)))
    # versions of one time come before the rows of that time, the largest last
    order = Window.partitionBy("_k", "_p").orderBy("_t", "_is", "_v")
    laid = both.withColumn("_now", F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_is = 1")
    ends = known.groupBy("_k", "_p").agg(F.max("_v").alias("_end"))
    parts = ends.unionByName(mine.select("_k", "_p").distinct().withColumn("_end", F.lit(None).cast(none))).groupBy("_k", "_p").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_k").alias("_ck"), F.col("_p").alias("_cp"), F.last("_end", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL")
    out = laid.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_p") == F.col("_cp")), "left")
    valid = F.coalesce("_now", "_before")
    return out.select("_row.*", *[F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), valid[c]).alias(c) for c in value])


def listed_versions(versions: DataFrame, key: str, at: str, hashes: str) -> DataFrame:
    """(key, number, at, files, added, changed, removed) of versions with a map of file hashes, oldest first: how many files each has and how they differ from those of the version before."""
    w = Window.partitionBy(key).orderBy(at, F.to_json(hashes))
    now, old = F.col(hashes), F.coalesce(F.lag(hashes).over(w), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    out = versions.select(key, at, F.row_number().over(w).cast("long").alias("number"), now.alias("_now"), old.alias("_old"))
    in_both = F.map_filter("_now", lambda k, v: F.map_contains_key(F.col("_old"), k))
    changed = F.size(F.map_filter(in_both, lambda k, v: ~v.eqNullSafe(F.try_element_at("_old", k))))
    return out.select(
        key, "number", at, F.size("_now").cast("long").alias("files"), (F.size("_now") - F.size(in_both)).cast("long").alias("added"), changed.cast("long").alias("changed"), (F.size("_old") - F.size(in_both)).cast("long").alias("removed"),
    )


def load_history(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """texts with entries: the JSON array of history entries (schema: DDL of one) that each text is; empty where it is none."""
    entry = f"array<struct<{schema}>>"
    parsed = F.when(F.ltrim(text).startswith("[") & F.try_parse_json(text).isNotNull(), F.from_json(text, entry))
    return texts.withColumn("entries", F.coalesce(parsed, F.array().cast(entry)))


def write_cycles(rows: DataFrame, path: str) -> None:
    """Write rows in folders by run_id and cycle; the folders that rows have are replaced, all others are left as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "cycle").parquet(path)


def read_cycles(spark: SparkSession, path: str, run: Column | None = None) -> DataFrame:
    """Rows of all runs, or of those that a condition on run_id and cycle keeps: only their folders are read."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if run is None else rows.where(run)


def runs(cycles: DataFrame, score: str) -> DataFrame:
    """(run_id, cycles, first, last, best, best_cycle) of each run: scores of its first and last cycle, and the first cycle with the best one."""
    by = cycles.groupBy("run_id", "cycle").agg(F.max(score).alias("_s"))
    return by.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cycles"), F.min_by("_s", "cycle").alias("first"), F.max_by("_s", "cycle").alias("last"), F.max("_s").alias("best"), F.max_by("cycle", F.struct("_s", -F.col("cycle"))).alias("best_cycle"),
    )
