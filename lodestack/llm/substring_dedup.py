"""Substring dedup by level-wise doubling.

A window of `window` words that two documents share contains equal shorter windows. Levels take lengths
that double from a start length up to `window`; each level looks only at windows whose shorter part was
repeated at the level before, and the search ends when none is left. Below the full length a window is
represented by its anchor, the part with the smallest hash, which is the same wherever the window stands;
so a level sends about 2 / (parts + 1) of the positions. Anchors are compared by a 64-bit hash, which may
only keep too many; full windows by 96 bits of two hashes that start from independent 64-bit hashes of each word.

Within a batch of documents only the smallest id's records of a key go to the key's bucket, so a passage that a
third of all documents share costs a few records a batch there. What the later documents repeat is known at
once: those places go, without a key, to buckets by document. Records are sorted by document and place and sent
as differences.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import exchange
from lodestack.llm.textarrays import Batch, batches, inside, longs, mix, window_hashes
from lodestack.llm.workspace import Workspace, bucket_count

#: Records that a task packs at once; bounds its memory.
FLUSH = 1_500_000


#: A search starts at a length of at most this, found by halving the window.
SHORT = 8
#: Columns of a record that are sent as differences: id, tag, position.
DELTAS = (2, 3, 4)


def doubling(start: int | None, window: int) -> list[int]:
    """start, twice that, and so on; the last length is window. None: the window halved until it is short."""
    if start is None:
        start = window
        while start > SHORT:
            start = (start + 1) // 2
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class _Anchors:
    """For every window of a batch (by start word): the place of its anchor of `length` words."""

    def __init__(self, h: np.ndarray, length: int, window: int):
        self.keys = window_hashes(h, length)
        m = max(0, len(h) - window + 1)
        low = self.keys[:m].copy()
        at = np.arange(m)
        for t in range(1, window - length + 1):
            new = self.keys[t : t + m]
            less = new < low
            low[less] = new[less]
            at[less] = np.flatnonzero(less) + t
        self.at = at


def _level_records(
    b: Batch, ids: np.ndarray, tags: np.ndarray, length: int, before: int | None, survivors: list[np.ndarray | None], window: int
) -> tuple[np.ndarray, ...] | None:
    """(bucket key, key, second key, id, tag, position) of what this level looks at in a batch."""
    h = b.hashes()
    alive = inside(b.first, window)
    if not alive.any():
        return None
    route = None
    if before is not None:
        old = _Anchors(h, before, window)
        mark = np.zeros(len(h), bool)
        for d, s in enumerate(survivors):
            if s is not None and len(s):
                mark[b.first[d] + s] = True
        alive &= mark[old.at]
        route = old.keys
    if length == window:
        at = np.flatnonzero(alive)
        keys = window_hashes(h, window)
        second = window_hashes(b.hashes(1), window, 1)[at].astype(np.uint32)
        routed = route[old.at[at]] if route is not None else keys[at]
    else:
        now = _Anchors(h, length, window)
        at = np.unique(now.at[alive])
        keys = now.keys
        second = np.zeros(len(at), np.uint32)
        routed = keys[at]
    doc = np.searchsorted(b.first, at, "right") - 1
    return routed, keys[at], second, ids[doc], tags[doc], (at - b.first[doc]).astype(np.int32)


def _localised(records: list[np.ndarray], buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets and records with a flag: 0 asks; 1 asks and a later document of the batch has it too; 2 is known as later."""
    order = np.lexsort((records[3], records[2], records[1]))
    routed, key, second, ident, tag, pos = (x[order] for x in records)
    run = exchange.runs(key, second)
    first = np.ones(len(run), bool)
    first[1:] = run[1:] != run[:-1]
    least = ident[first][run]
    later = ident > least
    many = np.bincount(run, weights=later) > 0
    flag = np.where(later, 2, many[run]).astype(np.uint8)
    bucket = (mix(np.where(later, mix(ident, 5) + tag, routed), 3) % np.uint64(buckets)).astype(np.int64)
    return bucket, [np.where(later, 0, key).astype(np.uint64), np.where(later, 0, second).astype(np.uint32), ident, tag, pos, flag]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated positions of each document in a bucket."""
    key, second, ident, tag, pos, flag = exchange.unpack(pdf, np.uint64, np.uint32, np.int64, np.uint32, np.int32, np.uint8, deltas=DELTAS)
    later = flag == 2
    repeated = later.copy()
    ask = np.flatnonzero(~later)
    order = ask[np.lexsort((ident[ask], second[ask], key[ask]))]
    if len(order):
        run = exchange.runs(key[order], second[order])
        first = np.ones(len(run), bool)
        first[1:] = run[1:] != run[:-1]
        after = ident[order] > ident[order][first][run]
        many = np.bincount(run, weights=after | (flag[order] == 1)) > 0
        later[order] = after
        repeated[order] = many[run]
    rows = np.flatnonzero(repeated)
    rows = rows[np.lexsort((pos[rows], tag[rows], ident[rows], later[rows]))]
    ident, tag, pos, later = ident[rows], tag[rows], pos[rows], later[rows]
    new = np.ones(len(rows), bool)
    new[1:] = (ident[1:] != ident[:-1]) | (tag[1:] != tag[:-1]) | (later[1:] != later[:-1]) | (pos[1:] > pos[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(rows))[: len(start)] - 1
    return pd.DataFrame({"_id": ident[start], "_tag": tag[start].astype(np.int64), "later": later[start], "a": pos[start], "b": pos[end] + 1})


def _spread(spans: list[dict] | None) -> np.ndarray | None:
    if spans is None:
        return None
    return np.concatenate([np.arange(s["a"], s["b"]) for s in spans]) if spans else np.empty(0, np.int64)


def dedup_substrings(
    docs: DataFrame, window: int = 13, start: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of docs as (id_col, n_words, removed array of (a, b) word ranges, kept_text).

    A word goes if a window over it also starts in a document with a smaller id; all windows are judged on
    the input. Null text: no words, empty kept_text. Ids are integers; a null id counts as larger than any.
    Rows with equal ids count as one document, so they take nothing from each other. Kept words are joined
    by one space; they are never changed.
    """
    ws = Workspace(docs.sparkSession, "substring-dedup")
    source = docs.select(
        F.col(id_col).alias("_given"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
        F.pmod(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(1 << 32)).alias("_tag"),
        F.col(text_col).alias("_text"),
    )
    buckets = bucket_count(source, "_text")
    lengths = doubling(start, window)
    found: DataFrame | None = None
    for n, length in enumerate(lengths):
        before = lengths[n - 1] if n else None
        if found is None:
            rows = source.select("_id", "_tag", "_text", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
        else:
            spans = found.groupBy("_id", "_tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
            rows = source.select("_id", "_tag", "_text").join(spans, ["_id", "_tag"]).select("_id", "_tag", "_text", "spans")
        answers = _level(rows, length, before, window, buckets)
        if n + 1 < len(lengths):
            before_it, found = found, ws.save(answers.select("_id", "_tag", "a", "b"), f"repeated-{length}")
            if before_it is not None:
                ws.drop(before_it)
            if found.limit(1).count() == 0:
                answers = answers.limit(0)
                break
    later = answers.where("later").groupBy("_id", "_tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            n, removed, kept = [], [], []
            for lo, _, b in batches(rb.column(1)):
                for d, words in enumerate(map(b.words, range(len(b.first) - 1))):
                    n.append(len(words))
                    starts = _spread(rb.column(2)[lo + d].as_py())
                    if starts is None or not len(starts):
                        removed.append([])
                        kept.append(b" ".join(words).decode("utf-8", "replace"))
                        continue
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed.append([{"a": x, "b": y} for x, y in edge.reshape(-1, 2).tolist()])
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.string())],
                ["_given", "n_words", "removed", "kept_text"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = source.join(later, ["_id", "_tag"], "left").select("_given", "_text", "spans").mapInArrow(
        cut, f"_given {kind}, n_words long, removed array<struct<a:int,b:int>>, kept_text string"
    )
    return out.withColumnRenamed("_given", id_col)


def _level(rows: DataFrame, length: int, before: int | None, window: int, buckets: int) -> DataFrame:
    """(_id, _tag, later, a, b): runs of places whose window or anchor of `length` words is repeated."""

    def send(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch:
            ids, tags = longs(rb.column(0)), longs(rb.column(1)).astype(np.uint32)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for lo, hi, b in batches(rb.column(2)):
                survivors = [_spread(x.as_py()) for x in rb.column(3)[lo:hi]] if before is not None else []
                got = _level_records(b, ids[lo:hi], tags[lo:hi], length, before, survivors, window)
                if got is not None:
                    held.append(got)
                    size += len(got[0])
                if size > FLUSH:
                    yield from exchange.pack(*_localised([np.concatenate(x) for x in zip(*held, strict=True)], buckets), DELTAS)
                    held, size = [], 0
            if held:
                yield from exchange.pack(*_localised([np.concatenate(x) for x in zip(*held, strict=True)], buckets), DELTAS)

    packed = rows.select("_id", "_tag", "_text", "spans").mapInArrow(send, exchange.schema(6))
    return packed.groupBy("bucket").applyInPandas(_answer, "_id long, _tag long, later boolean, a int, b int")
