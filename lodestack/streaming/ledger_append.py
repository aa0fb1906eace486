"""A stream of events appended to a signed, hash-chained log: the last signature of each chain is the stream's state."""
from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ENTRY = "chain string, seq bigint, payload string, prev_signature string, signature string"
STATE = "seq bigint, signature string"


def message(payload: str, prev: str) -> str:
    return f"{payload}|{prev}"


def signed(payload: str = "payload", prev: str = "prev_signature") -> Column:
    """What the signature of an entry is of, for ledger.verify and ledger.integrity."""
    return F.concat(F.col(payload), F.lit("|"), F.coalesce(F.col(prev), F.lit("")))


def last_signatures(log: DataFrame) -> DataFrame:
    """(chain, seq, signature) of the last entry of each chain: where a stream that goes on with a log begins."""
    return log.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("signature", "seq").alias("signature"))


class Signer(StatefulProcessor):
    """Signs a chain's new events, in their order within a batch, each linked to the entry before it."""

    def __init__(self, key: bytes, order: Sequence[str]):
        self.key, self.order = key, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for seq, signature in zip(initialState["seq"], initialState["signature"], strict=True):
            self.last.update((int(seq), signature))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, prev = self.last.get() if self.last.exists() else (-1, "")
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # a micro-batch's events of one chain
        out = []
        for payload in new["payload"]:
            signature = hmac.new(self.key, message(payload, prev).encode(), hashlib.sha256).hexdigest()
            seq += 1
            out.append((key[0], seq, payload, prev, signature))
            prev = signature
        self.last.update((seq, prev))
        yield pd.DataFrame(out, columns=["chain", "seq", "payload", "prev_signature", "signature"])

    def close(self) -> None:
        pass


def sign(events: DataFrame, key: bytes, order: Sequence[str], log: DataFrame | None = None) -> DataFrame:
    """The entries (ENTRY) of a stream of events (chain, payload and the columns of order). log: entries to go on from, read when the stream first starts.

    Events of a micro-batch are signed in their order; bound a batch by the source's options. Needs the RocksDB state store.
    """
    initial = last_signatures(log).groupBy("chain") if log is not None else None
    return events.groupBy("chain").transformWithStateInPandas(Signer(key, order), outputStructType=ENTRY, outputMode="Append", timeMode="None", initialState=initial)


def append(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the entries of a stream to path, all that is available, each once, whatever broke off before."""
    return entries.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def review(page: DataFrame, integrity: DataFrame, chain: str = "chain") -> DataFrame:
    """A page of entries with the counts of their chain's check, and whether all of it is good."""
    counts = integrity.withColumn("intact", (F.col("invalid") == 0) & (F.col("parse_errors") == 0))
    return page.join(counts, chain, "left")
