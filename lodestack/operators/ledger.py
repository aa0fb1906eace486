"""A signed, hash-chained log: HMAC-SHA256 by built-in functions, links by a window or a fold over each chain."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key of at most 64 bytes."""
    key = key.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


def hmac_sha256(message: Column, key: bytes) -> Column:
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def verify(log: DataFrame, chain: str, order: str, payload: Column, key: bytes) -> DataFrame:
    """log with good_signature and good_link; the first entry of a chain links to nothing (null or empty)."""
    before = F.lag("signature").over(Window.partitionBy(chain).orderBy(order))
    linked = F.coalesce(F.col("prev_signature"), F.lit("")) == F.coalesce(before, F.lit(""))
    return log.withColumn("good_signature", F.col("signature") == hmac_sha256(payload, key)).withColumn("good_link", linked)


def integrity(log: DataFrame, chain: str, order: str, payload: Column, key: bytes, readable: Column | None = None) -> DataFrame:
    """(chain, valid, invalid, parse_errors) of every chain.

    An entry is valid if its signature is good and it links to the last valid entry (the first to nothing, null or
    empty), so what follows a forged or deleted entry is invalid. Entries that aren't readable count as parse errors
    only. A chain is read in order by one task, which holds a batch of it and the last valid signature.
    """
    kind = log.schema[chain].dataType.simpleString()
    good, read = F.coalesce(F.col("signature") == hmac_sha256(payload, key), F.lit(False)), F.lit(True) if readable is None else F.coalesce(readable, F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    entries = log.select(F.col(chain).alias("_chain"), F.col(order).alias("_at"), good.alias("_good"), read.alias("_read"), text("prev_signature").alias("_prev"), text("signature").alias("_sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n = None, "", None  # n: valid, invalid and unreadable entries of chain now
        for rb in batches:
            done = []
            for name, ok, read, prev, sig in zip(*(rb.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if n is None or name != now:
                    if n is not None:
                        done.append((now, *n))
                    now, last, n = name, "", [0, 0, 0]
                if not read:
                    n[2] += 1
                elif ok and prev == last:
                    n[0] += 1
                    last = sig
                else:
                    n[1] += 1
            yield out(done, rb.schema.field(0).type)
        if n is not None:
            yield out([(now, *n)], rb.schema.field(0).type)

    def out(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], of), *(pa.array(c, pa.int64()) for c in cols[1:])], ["_chain", "valid", "invalid", "parse_errors"])

    ordered = entries.repartition("_chain").sortWithinPartitions("_chain", "_at", "_sig", "_prev")
    return ordered.mapInArrow(run, f"_chain {kind}, valid long, invalid long, parse_errors long").withColumnRenamed("_chain", chain)
