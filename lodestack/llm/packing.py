"""Bound-certified best-fit packing of documents into sequences of a fixed length.

Pieces of full length are sequences of their own. The others are dealt into groups of bounded size, and each
group is packed by best-fit decreasing. A group's lower bound comes from dual-feasible functions (Martello-
Toth's threshold family and Fekete-Schepers' rounding family): no packing can use fewer bins. A group that
meets its bound is certified and keeps its bins, but for the one that its fraction of a bin leaves open; a
group with a gap gives up all bins that are not full. What is given up is exchanged: dealt anew into fewer
groups, in proportion to its size, and packed again by best-fit decreasing. Rounds end when the whole packing
meets the bound over all lengths, or when a round saves no bin (its result is then left out).
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.textarrays import batches
from lodestack.llm.wordbpe import WordEncoder
from lodestack.llm.workspace import Workspace

#: Pieces in a group.
GROUP = 50_000
ROUNDS = 6


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """Bins that any packing needs, before rounding up. counts[x]: pieces of length x, 0 to capacity."""
    x = np.arange(len(counts), dtype=np.int64)
    best = float(counts @ x) / capacity
    large = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    volume = np.concatenate([[0], np.cumsum(counts * x)])
    for cut in range(capacity // 2 + 1):  # over capacity - cut counts as full, under cut as nothing
        full = large[capacity - cut + 1] if cut else 0
        best = max(best, float(full) + float(volume[capacity - cut + 1] - volume[cut]) / capacity)
    for k in range(1, 33):
        scaled = x * (k + 1)
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity) / (k * capacity)
        best = max(best, float(counts @ f))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset there, and the room left in each bin, by best-fit decreasing."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = open_by_room[r].pop()
            if not open_by_room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r = r - n
        if r:
            open_by_room[r].append(b)
            mask |= 1 << r
    return bins, offsets, np.array(room, np.int64)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece: ids of the text, then end_id, cut at capacity."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for rb in rows:
            for lo, _, b in batches(rb.column(1), limit=4 << 20):
                ids, ends = encoder.encode(b)
                n = np.diff(ends) + 1
                all_ids = np.full(len(ids) + len(n), end_id, "<u4")
                firsts = np.concatenate([[0], np.cumsum(n)])
                all_ids[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw = memoryview(all_ids.tobytes())
                at = (firsts[doc] + start).tolist()
                spans = [raw[4 * a : 4 * (a + m)] for a, m in zip(at, length.tolist(), strict=True)]
                columns = [
                    rb.column(0).take(pa.array(lo + doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(s) for s in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def _counts(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces by length: at most capacity + 1 rows, whatever the input."""
    out = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        out[r["length"]] = r["count"]
    return out


def _fitter(turn: int, capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs a group of a round, and marks the bins that it gives up."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        give = room > 0
        if len(room) <= int(np.ceil(bound - 1e-9)):  # certified: only the emptiest bin can shrink, with others' help
            give = np.zeros(len(room), bool)
            give[np.argmax(room)] = room.max() > 0
        sequence = (np.int64(turn) << 56) | (np.int64(key[0]) << 28) | bins
        return pdf.drop(columns="_group").assign(sequence_id=sequence, offset=offsets, given=give[bins])

    return fit


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, group: int = GROUP, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document is the ids of its text, then id 0, so a null or empty text is one piece of one token. Only
    documents over capacity are cut. Repeated rows and null ids are packed like any others. An empty table
    gives an empty result. with_ids adds the ids (little-endian unsigned 32-bit), see sequences().
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    pieces = tokenised(docs, tokenizer, capacity, 0, id_col, text_col, with_ids)
    pieces = ws.save(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("_uid")).withColumn("offset", F.lit(0).cast("long"))
    pool = pieces.where(F.col("length") < capacity)
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, given boolean"
    counts = _counts(pool, capacity)
    n, bound = int(counts.sum()), int(np.ceil(lower_bound(counts, capacity) - 1e-9))
    done: list[DataFrame] = [full]
    kept_bins, pool_bins = 0, None
    held: DataFrame | None = None  # the pool's places from the round before

    for turn in range(rounds):
        if n == 0:
            break
        least = int(spark.conf.get("spark.sql.shuffle.partitions")) if turn == 0 else 1
        groups = max(1, min(least, n // 1000), n // group)

        dealt = pool.withColumn("_group", F.pmod(F.xxhash64("_uid", F.lit(turn)), F.lit(groups)))
        placed = dealt.groupBy("_group").applyInPandas(_fitter(turn, capacity), schema)
        placed = ws.save(placed, f"round-{turn}")
        by = {r["given"]: r["count"] for r in placed.where("offset = 0").groupBy("given").count().collect()}
        now = sum(by.values())
        if pool_bins is not None and now >= pool_bins:
            break
        done.append(placed.where("NOT given").select(*columns, "sequence_id", "offset"))
        kept_bins += by.get(False, 0)
        pool_bins = by.get(True, 0)
        held = placed.where("given").select(*columns, "sequence_id", "offset")
        pool = held.select(*columns)
        n = pool.count()
        if kept_bins + pool_bins <= bound or groups == 1:
            break
    if held is not None:
        done.append(held)
    return reduce(DataFrame.unionByName, done).drop("_uid")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>) of pack(..., with_ids=True): the ids in the order of their offsets, a bounded number."""

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("offset")["ids"])
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.frombuffer(raw, "<u4").astype(np.int64)]})

    return placed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>")
