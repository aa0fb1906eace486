"""Benchmark decontamination by a prefix-filtered set join, verified exactly.

A window is `words` consecutive words of a benchmark item (an item of fewer words is one window). Its
shingles (3 words, or all of a shorter window) are ordered by rarity in the corpus. A document holds the
window only if it holds all its shingles, so the necessary prefix is the one rarest shingle: documents'
shingles are joined with these prefix shingles only. A match at word p, with the shingle at offset o,
leaves one place: the window must start at p - o (positional bound) and end inside the document (length
bound); there the words are compared exactly.

Benchmark windows are taken in blocks of bounded size, each a table of at most `block` windows that every
task gets, and documents are scanned once a block, so a large benchmark costs scans, never memory.
"""
from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.textarrays import LOWER_BYTES, NON_ALNUM, batches, window_hashes
from lodestack.llm.workspace import Workspace

SHINGLE = 3
_TO_SPACE = bytes(0x20 if NON_ALNUM[b] else b for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_BYTES).translate(_TO_SPACE).split()


class Windows:
    """A block of benchmark windows: their shingles, and after rank() their prefixes."""

    def __init__(self, texts: list[tuple[bytes, ...]]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        keyed = pa.array([b" ".join(t).decode() for t in texts], pa.large_string())
        self.size = np.minimum(self.lengths, SHINGLE)
        shingles: list[np.ndarray] = []
        for _, _, b in batches(keyed):
            h = b.hashes()
            for d in range(len(b.first) - 1):
                w = h[b.first[d] : b.first[d + 1]]
                shingles.append(window_hashes(w, min(len(w), SHINGLE)))
        self.shingles = shingles
        self.sizes = sorted(set(self.size.tolist()))
        self.distinct = {s: np.unique(np.concatenate([x for x, z in zip(shingles, self.size, strict=True) if z == s])) for s in self.sizes}

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle: its key, and its offset in the window."""
        by: dict[int, dict[int, list[tuple[int, int]]]] = {s: defaultdict(list) for s in self.sizes}
        for w, (hashes, s) in enumerate(zip(self.shingles, self.size.tolist(), strict=True)):
            h = hashes.view(np.int64).tolist()
            offset = min(range(len(h)), key=lambda i: (counts.get((s, h[i]), 0), h[i]))
            by[s][h[offset]].append((offset, w))
        self.prefix = by
        self.keys = {s: np.sort(np.array(list(m), np.int64).view(np.uint64)) for s, m in by.items()}


def _member(h: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in h whose value is in the sorted keys. table: a bitmap of the keys' low bits."""
    maybe = np.flatnonzero(table[(h & np.uint64(len(table) - 1)).astype(np.int64)])
    at = np.searchsorted(keys, h[maybe])
    return maybe[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[maybe])]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = max(16, int(np.ceil(np.log2(len(keys) + 1))) + 5)
    table = np.zeros(1 << min(bits, 24), bool)
    table[(keys & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return table


def _count(docs: DataFrame, windows: Windows, text_col: str) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in the corpus. Bounded by the block."""
    distinct = windows.distinct

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: _bitmap(k) for s, k in distinct.items()}
        sums = {s: np.zeros(len(k), np.int64) for s, k in distinct.items()}
        for rb in source:
            for _, _, b in batches(rb.column(0), NON_ALNUM, lower=True):
                h = b.hashes()
                for s, keys in distinct.items():
                    g = window_hashes(h, s)
                    hit = _member(g, keys, tables[s])
                    sums[s] += np.bincount(np.searchsorted(keys, g[hit]), minlength=len(keys))
        for s, keys in distinct.items():
            some = np.flatnonzero(sums[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), s, np.int32)), pa.array(keys[some].view(np.int64)), pa.array(sums[s][some])], ["s", "h", "n"]
            )

    rows = docs.select(text_col).mapInArrow(scan, "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n"))
    return {(r["s"], r["h"]): r["n"] for r in rows.toLocalIterator()}


def _hits(docs: DataFrame, windows: Windows, names: list[list[str]], id_col: str, text_col: str) -> DataFrame:
    """Per document: id, n_words, hit words as sorted positions, and the items that have windows in it."""
    keys, prefix, texts, lengths = windows.keys, windows.prefix, windows.texts, windows.lengths.tolist()

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: _bitmap(k) for s, k in keys.items()}
        joined = [b" ".join(t) for t in texts]
        for rb in source:
            n = np.zeros(rb.num_rows, np.int64)
            hit: list[np.ndarray | list[int]] = [[]] * rb.num_rows
            found: list[list[str]] = [[]] * rb.num_rows
            for lo, hi, b in batches(rb.column(1), NON_ALNUM, lower=True):
                n[lo:hi] = b.n
                h = b.hashes()
                raw, first = b.buf.tobytes(), b.first
                inside: dict[int, set[int]] = defaultdict(set)
                spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
                for s, own in keys.items():
                    g = window_hashes(h, s)
                    at = _member(g, own, tables[s])
                    doc = np.searchsorted(first, at, "right") - 1
                    for p, d, k in zip(at.tolist(), doc.tolist(), g[at].view(np.int64).tolist(), strict=True):
                        left, right = int(first[d]), int(first[d + 1])
                        for offset, w in prefix[s][k]:
                            a, e = p - offset, p - offset + lengths[w]
                            if a < left or e > right:
                                continue
                            same = raw[b.start[a] : b.end[e - 1]]
                            if same != joined[w]:
                                same = b" ".join(raw[x:y] for x, y in zip(b.start[a:e].tolist(), b.end[a:e].tolist(), strict=True))
                            if same == joined[w]:
                                inside[d].add(w)
                                spans[d].add((a - left, e - left))
                for d, own_spans in spans.items():
                    mark = np.zeros(int(b.n[d]), bool)
                    for a, e in own_spans:
                        mark[a:e] = True
                    hit[lo + d] = np.flatnonzero(mark).astype(np.int32)
                    found[lo + d] = sorted({x for w in inside[d] for x in names[w]})
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(n), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                ["id", "n_words", "hit", "items"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, n_words long, hit array<int>, items array<string>")


def _blocks(items: DataFrame, words: int, block: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows with their items, block windows at a time; one block at least."""
    now: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    given = False
    for name, text in items.toLocalIterator():
        own = item_words(text)
        for i in range(max(1, len(own) - words + 1) if own else 0):
            now[tuple(own[i : i + words])].add(name)
        if len(now) >= block:
            yield now
            now, given = defaultdict(set), True
    if now or not given:
        now[(b"\x00",)] = set()  # no word holds a NUL: this keeps an empty block simple and matches nothing
        yield now


def _occurrences(docs: DataFrame, block: dict[tuple[bytes, ...], set[str]], id_col: str, text_col: str) -> DataFrame:
    windows = Windows(list(block))
    windows.rank(_count(docs, windows, text_col))
    return _hits(docs, windows, [sorted(x) for x in block.values()], id_col, text_col)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, words: int = 10, block: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every row of docs as (id_col, n_words, hit array of word positions, items array of item ids as text).

    Null and empty texts have no words and no hits; a null or repeated item id counts as the text "null" or
    as one item; a benchmark without words leaves every document clean. Words: A-Z lower-cased, cut at every
    ASCII byte that is no letter or digit.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    blocks = _blocks(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), item_text_col), words, block)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        out = _occurrences(docs, first, id_col, text_col)
        return out.select(F.col("id").alias(id_col), "n_words", "hit", "items")
    rows = ws.save(docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col), "docs")
    parts = [ws.save(_occurrences(rows, x, "_row", text_col), "block") for x in itertools.chain([first, second], blocks)]
    union = functools.reduce(DataFrame.unionByName, parts)
    merged = union.groupBy(F.col("id").alias("_row")).agg(  # a row for each block and document
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.select("_row", id_col).join(merged, "_row").select(id_col, "n_words", "hit", "items")
