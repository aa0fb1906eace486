"""A ledger read as a stream: counts of signed and forged entries in event-time windows, late entries within a bound."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ledger import hmac_sha256


def tail(log: DataFrame, payload: Column, key: bytes, at: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, good, forged) of a stream or table of entries with `signature`. State is bounded by the watermark."""
    checked = log.withWatermark(at, late).withColumn("_good", F.col("signature") == hmac_sha256(payload, key))
    return checked.groupBy(F.window(at, window)).agg(F.count_if(F.col("_good")).alias("good"), F.count_if(~F.col("_good")).alias("forged"))
