"""Document quality by a linear-chain conditional random field over lines.

Every line of a text gets a label, good or bad. A line's potentials come from its own features and those of
the lines before and after; neighbouring labels have potentials of their own. Forward-backward gives each
line's probability of being good, and their mean, weighted by the lines' lengths, becomes the document's
quality, through a logistic curve fitted on the same sample.

The field is trained on documents whose lines all take the document's label, by gradient ascent on
the penalised conditional likelihood. The sample is bounded (SAMPLE documents a label, in the order of a hash of
the id), and of each the whole text is read, as in scoring. Features are
counts on bytes and words, computed by numpy for a batch of documents at once; the recursions run over all
lines of a batch as one scan of 2 x 2 matrices, where a document's first line has a matrix of rank one, so
that nothing passes from one document to the next.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.textarrays import Batch, batches, mix

#: Labelled documents of each label that the field is fitted on.
SAMPLE = 2_000
STEPS = 150
PENALTY = 1e-3

_byte = np.arange(256)
_alpha = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: Classes of bytes whose share in a line is a feature.
BYTE_CLASSES = {
    "upper": (_byte >= 65) & (_byte <= 90),
    "digit": (_byte >= 48) & (_byte <= 57),
    "stop": np.isin(_byte, list(b".,;:?'\"-()")),
    "shout": _byte == ord("!"),
    "bar": _byte == ord("|"),
    "mark": np.isin(_byte, list(b"#$%&*@^~=+_\\")),
    "bracket": np.isin(_byte, list(b"<>{}[]/")),
    "control": (_byte < 32) & ~np.isin(_byte, [9, 10, 13]) | (_byte == 127),
    "wide": _byte >= 128,
}
NAMES = [*BYTE_CLASSES, "length", "words", "word_length", "short_words", "marked_words", "repeated_words", "doubled_words", "repeated_line", "ends_stop", "empty"]
WIDTH = len(NAMES)


def line_features(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes, and the first line of each document (bounds)."""
    docs = len(b.bounds) - 1
    breaks = np.flatnonzero(b.buf == 10)
    doc_of_break = np.searchsorted(b.bounds, breaks, "right") - 1
    lines = np.bincount(doc_of_break, minlength=docs) + 1 if docs else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(lines)])
    n = int(first[-1])
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    start[is_first], end[is_last] = b.bounds[:-1], b.bounds[1:]
    start[~is_first], end[~is_last] = breaks + 1, breaks
    length = end - start
    out = np.zeros((n, WIDTH), np.float32)
    size = np.maximum(length, 1)
    total = np.zeros(len(b.buf) + 1, np.int64)
    for i, table in enumerate(BYTE_CLASSES.values()):
        np.cumsum(table[b.buf], out=total[1:])
        out[:, i] = (total[end] - total[start]) / size
    w0, w1 = np.searchsorted(b.start, start), np.searchsorted(b.start, end)
    words = w1 - w0
    many = np.maximum(words, 1)
    line = np.repeat(np.arange(n), words)
    wl = b.end - b.start
    last = b.buf[np.maximum(b.end - 1, 0)] if len(b.buf) else np.empty(0, np.uint8)
    marked = ~(_alpha | BYTE_CLASSES["digit"] | BYTE_CLASSES["stop"])[last]
    h = b.hashes()
    distinct = np.unique((line.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    per_line = np.bincount((distinct >> np.uint64(36)).astype(np.int64), minlength=n)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    share = lambda x: np.bincount(line, weights=x, minlength=n) / many
    at = len(BYTE_CLASSES)
    out[:, at] = np.log1p(length)
    out[:, at + 1] = np.log1p(words)
    out[:, at + 2] = np.log1p(share(wl))
    out[:, at + 3] = share(wl <= 3)
    out[:, at + 4] = share(marked)
    out[:, at + 5] = 1 - per_line / many
    out[:, at + 6] = share(doubled)
    line_hash = mix(np.add.reduceat(np.append(mix(h + mix(np.arange(len(h), dtype=np.uint64) - np.repeat(w0, words).astype(np.uint64))), np.uint64(0)), np.minimum(w0, len(h))) if n else h[:0])
    doc_of_line = np.repeat(np.arange(docs), lines)
    key = line_hash ^ mix(doc_of_line.astype(np.uint64), 5)
    _, place, again = np.unique(key, return_inverse=True, return_counts=True)
    out[:, at + 7] = (again[place] > 1) & (words > 2)
    closing = b.buf[np.maximum(end - 1, 0)] if len(b.buf) else np.zeros(n, np.uint8)
    out[:, at + 8] = np.isin(closing, list(b".?!:\"")) & (length > 0)
    out[:, at + 9] = words == 0
    return out, length, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at a document's edges), edge flags and 1."""
    n = len(x)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([x, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1, dtype=np.float32)


def _scan(m: np.ndarray, longest: int) -> np.ndarray:
    """Running products of matrices, back to the document's first at least, each scaled to a largest entry of 1."""
    m = m.copy()
    step = 1
    while step < longest:
        new = m[:-step] @ m[step:]
        m[step:] = new / new.max(axis=(1, 2), keepdims=True)
        step *= 2
    return m


def marginals(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each line and P(label, next label) of each line that has one. unary: n x 2 log potentials."""
    n = len(unary)
    if n == 0:
        return np.zeros((0, 2)), np.zeros((0, 2, 2))
    scale = np.exp(unary - unary.max(axis=1, keepdims=True))
    step = np.exp(pair - pair.max())
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    forward = np.where(head[:, None, None], 1.0, step) * scale[:, None, :]
    longest = int(np.diff(first).max())
    alpha = _scan(forward, longest)[:, 0, :]
    backward = np.where(tail[:, None, None], 1.0, step * np.roll(scale, -1, axis=0)[:, None, :])
    beta = _scan(np.ascontiguousarray(backward[::-1].transpose(0, 2, 1)), longest)[::-1, 0, :]
    one = alpha * beta
    one /= one.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(~tail)
    two = alpha[inner, :, None] * step * (scale[inner + 1] * beta[inner + 1])[:, None, :]
    return one, two / two.sum(axis=(1, 2), keepdims=True)


@dataclass
class LineField:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of features, for label good against bad
    pair: np.ndarray
    slope: float
    offset: float

    def good(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        u = with_neighbours((x - self.mean) / self.spread, first) @ self.weights
        return marginals(np.stack([-u / 2, u / 2], axis=1), self.pair, first)[0][:, 1]

    def quality(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each document, 0 to 1. A document's empty lines weigh as one byte each."""
        return 1 / (1 + np.exp(-(self.slope * _share(self.good(x, first), length, first) + self.offset)))


def _share(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    w = np.maximum(length, 1).astype(float)
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


def _adam(start: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, prior: float, steps: int = STEPS) -> LineField:
    """Fit on documents' lines. label: 0 or 1 of each document; prior: share of label 1 among all labelled."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    f = with_neighbours((x - mean) / spread, first).astype(float)
    lines = np.diff(first)
    y = np.repeat(label, lines)
    counts = np.bincount(label, minlength=2)
    share = np.where(label == 1, prior / max(1, counts[1]), (1 - prior) / max(1, counts[0]))  # undoes the sample's balance
    even = np.where(label == 1, 0.5 / max(1, counts[1]), 0.5 / max(1, counts[0]))
    w = np.repeat(even / lines, lines)
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((len(inner), 2, 2))
    seen[np.arange(len(inner)), y[inner], y[inner]] = 1
    d = f.shape[1]

    def gradient(p: np.ndarray) -> np.ndarray:
        u = f @ p[:d]
        one, two = marginals(np.stack([-u / 2, u / 2], axis=1), p[d:].reshape(2, 2), first)
        g = f.T @ (w * (y - one[:, 1])) - PENALTY * p[:d]
        return np.concatenate([g, (np.einsum("i,ijk->jk", w[inner], seen - two) - PENALTY * p[d:].reshape(2, 2)).reshape(-1)])

    p = _adam(np.zeros(d + 4), gradient, steps, 0.1)
    field = LineField(mean, spread, p[:d], p[d:].reshape(2, 2), 1.0, 0.0)
    q = _share(field.good(x, first), length, first)

    def logistic(p: np.ndarray) -> np.ndarray:
        e = share * (label - 1 / (1 + np.exp(-(p[0] * q + p[1]))))
        return np.array([e @ q, e.sum()]) - 1e-5 * p

    field.slope, field.offset = _adam(np.array([4.0, -2.0]), logistic, 2000, 0.05).tolist()
    return field


def may_learn(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels may be used: crc32 of the id's text modulo folds is not 0. A null id never is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, folds: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> LineField | None:
    """Fit on a bounded sample of the labelled rows that may be learned from; None if a label has none.

    Rows without a label (null, or neither 0 nor 1) and with a null id are not used; of an id labelled twice the
    larger label counts.
    """
    own = labels.where(may_learn(F.col(id_col), folds) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    order = F.xxhash64("_id", F.lit("sample"))
    chosen = own.where("_y = 0").orderBy(order, "_id").limit(sample).unionByName(own.where("_y = 1").orderBy(order, "_id").limit(sample))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # 2 * sample ids; of rows with one id the least text counts, whatever their order
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def describe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in source:
            for lo, hi, b in batches(rb.column(2)):
                x, length, first = line_features(b)
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(lo, hi - lo), rb.column(1).slice(lo, hi - lo), pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()),
                     pa.array([length[a:z].tobytes() for a, z in cut], pa.binary())],
                    ["_id", "y", "x", "length"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.select("_id", "_y", "_text").mapInArrow(describe, f"_id {kind}, y int, x binary, length binary")
    got = got.toPandas().sort_values("_id", ignore_index=True)
    if set(got["y"]) != {0, 1}:
        return None
    lengths = [np.frombuffer(v, np.int64) for v in got["length"]]
    first = np.concatenate([[0], np.cumsum([len(v) for v in lengths])])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH)
    return fit(x, np.concatenate(lengths), first, got["y"].to_numpy(np.int64), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, field: LineField | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column more: each text's quality. Null is an empty text, which is one empty line; without a field all get 0.5."""
    if field is None:
        return docs.withColumn(name, F.lit(0.5))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = [np.zeros(0)]
            for _, _, b in batches(pa.array(s, pa.large_string(), from_pandas=True)):
                out.append(field.quality(*line_features(b)))
            yield pd.Series(np.concatenate(out))

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col(text_col)))
