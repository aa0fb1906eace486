"""Sharding by sampled splitters: quantiles of a size-weighted key sample cut the key space into ranges.

Rows are ordered by (hash of the text, id). Size-weighted sampling (each row with a chance in proportion to its
size, by a hash of the row, so a retried task draws the same) gives splitters; ranges that
turn out over twice their share are subdivided at the ids sampled in them, so a group of copies holding a
third of all bytes is spread. Range totals (one row a range, of a bounded number) give each range its
place in the order; inside a range a running sum places each row, and shards are equal cuts of the total.
A group of equal texts of at most a hundredth of a shard stays in one shard; larger groups are cut by row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.workspace import Workspace

#: Overhead of a record, added to the bytes of its text.
RECORD_BYTES = 16


def _range_of(key: np.ndarray, ident: np.ndarray, at_key: np.ndarray, at_id: np.ndarray) -> np.ndarray:
    """Number of splitters (key, id) at or below each row. Splitters are sorted."""
    lo = np.searchsorted(at_key, key, "left")
    hi = np.searchsorted(at_key, key, "right")
    out = hi.copy()
    for a, b in {(int(x), int(y)) for x, y in zip(lo[lo < hi], hi[lo < hi], strict=True)}:
        rows = (lo == a) & (hi == b)
        out[rows] = a + np.searchsorted(at_id[a:b], ident[rows], "right")
    return out


def shard(
    docs: DataFrame, shards: int = 40, ranges_per_shard: int = 16, rows_per_range: int = 500_000, samples_per_range: int = 32,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot, key) of every row. slot counts from 0 in each shard.

    Null text: size 16, crc32 of nothing; null ids come first in the order, rows repeated in full have
    neighbouring slots. An empty table gives an empty result. There are ranges_per_shard ranges a shard, or as many as
leave rows_per_range rows to each; the driver holds about samples_per_range rows a range, which is a row in 15,000
where rows are many.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = ws.save(
        docs.select(
            F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("key"),
            (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "rows",
    )
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(shards * ranges_per_shard, n_rows // rows_per_range)
    wanted = samples_per_range * parts
    uniform = (F.pmod(F.xxhash64("key", "_id", F.lit("sample")), F.lit(1 << 52)) + 1) / float(1 << 52)
    sample = (
        rows.where(uniform * max(1, total) <= F.col("size") * wanted).select("key", F.coalesce("_id", F.lit(-(1 << 63))).alias("i"))
        .toPandas().sort_values(["key", "i"], ignore_index=True)
    )
    picks = sample.iloc[np.unique(np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1])] if len(sample) else sample
    at_key = np.unique(picks["key"].to_numpy(np.int64))
    low = np.iinfo(np.int64).min

    def ranged(at_key: np.ndarray, at_id: np.ndarray) -> DataFrame:
        @F.pandas_udf("int")
        def place(key: pd.Series, ident: pd.Series) -> pd.Series:
            i = ident.fillna(low).to_numpy(np.int64) if ident.dtype != np.int64 else ident.to_numpy()
            return pd.Series(_range_of(key.to_numpy(np.int64), i, at_key, at_id).astype(np.int32))

        # ids beyond 2^53 must not pass through a float column
        return ws.save(rows.withColumn("range", place("key", F.coalesce("_id", F.lit(low)))), "ranged")

    def totals(df: DataFrame) -> pd.DataFrame:
        return df.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("range")

    at_id = np.full(len(at_key), low)
    dealt = ranged(at_key, at_id)
    sums = totals(dealt)
    over = sums.loc[sums["bytes"] * parts > 2 * total, "range"].to_numpy()
    if len(over) and len(sample):
        of = _range_of(sample["key"].to_numpy(np.int64), sample["i"].to_numpy(np.int64), at_key, at_id)
        more = []
        for r in over.tolist():
            own = sample[of == r]
            pieces = int(np.ceil(float(sums.loc[sums["range"] == r, "bytes"].iloc[0]) * parts / max(1, total)))
            if len(own):
                more.append(own.iloc[np.unique(np.linspace(0, len(own) - 1, pieces + 1).astype(int)[1:-1])])
        if more:
            extra = pd.concat([pd.DataFrame({"key": at_key, "i": at_id}), *more]).drop_duplicates().sort_values(["key", "i"])
            ws.drop(dealt)
            dealt = ranged(extra["key"].to_numpy(np.int64), extra["i"].to_numpy(np.int64))
            sums = totals(dealt)
    sums["bytes_before"] = sums["bytes"].cumsum() - sums["bytes"]
    sums["rows_before"] = sums["n"].cumsum() - sums["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(
        list(sums[["range", "bytes_before", "rows_before"]].astype("int64").itertuples(index=False, name=None)),
        "range int, bytes_before long, rows_before long",
    )
    order = Window.partitionBy("range").orderBy("key", "_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "key")
    placed = (
        dealt.join(F.broadcast(offsets), "range")  # a row for each range: at most a few times shards * ranges_per_shard
        .withColumn("at", F.col("bytes_before") + F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_at", F.min("at").over(group))
    )
    whole = F.col("group_bytes") * (100 * shards) <= total
    middle = F.when(whole, F.col("group_at") + F.col("group_bytes") / 2).otherwise(F.col("at") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int"))
    placed = ws.save(placed.select("_id", "size", "text_crc32", "shard", "rank", "key"), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "key"
    )
