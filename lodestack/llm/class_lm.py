"""Brown class-based bigram language model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Words are classed by exchange clustering: a unit moves to the class that most raises the likelihood of the
class bigrams, computed exactly from its own contexts, and class counts follow each move; unit contexts are
counted anew over the whole corpus after every pass. Units are the most frequent words (a documented bound),
and for every other word, known or not, the group of words with its ending (a hash of up to three last
bytes); so every word has a class, the map from words to classes has a bounded size, and any task can class
any text without a lookup in the vocabulary.

Counts are of the whole corpus. Word counts, class vocabularies and unit bigrams are shuffled as packed
arrays, aggregated in each task first. Scoring adds log10 terms: those of the most frequent words are
computed where the text is; other words of a document go, once each, to their bucket of the vocabulary, and
their sums come back by document.

Smoothing: class bigrams add SMOOTH_CLASS to each count, words add 0.1 to each count in their class and one
unknown word a class, so that the probabilities of the known words and the unknown ones add up to 1.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import exchange
from lodestack.llm.textarrays import Batch, batches, mix, signed
from lodestack.llm.workspace import Workspace, bucket_count

#: Frequent words that are units of their own.
UNITS = 16_384
#: Groups of other words, by ending.
ENDINGS = 4_096
#: Frequent words whose counts every task holds.
HEAD = 262_144
CLASSES = 32
PASSES = 6
SMOOTH_WORD = 0.1
SMOOTH_CLASS = 0.5
#: Records that a task packs at once; bounds its memory.
FLUSH = 1_000_000
#: The end of a document, as a word hash.
END = np.uint64(0x5EED_0F_E17D_0C5)


def is_held_out(doc_id: Column, buckets: int = 10) -> Column:
    """Rows that the model must not learn from: crc32 of the id's text modulo buckets is 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets)) == 0, F.lit(True))


def endings(b: Batch) -> np.ndarray:
    """Group of each word by its last bytes, three at most."""
    length = b.end - b.start
    key = np.zeros(len(length), np.uint64)
    for t in (1, 2, 3):
        at = np.maximum(b.end - t, 0)
        byte = b.buf[at].astype(np.uint64) if len(at) else key
        key = key * np.uint64(257) + np.where(length >= t, byte + np.uint64(1), 0).astype(np.uint64)
    return (mix(key, 23) % np.uint64(ENDINGS)).astype(np.int32)


class Lookup:
    """Places of word hashes in a sorted table, -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(24, max(16, int(np.ceil(np.log2(len(keys) + 1))) + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.some = np.zeros(1 << bits, bool)
        self.some[(keys & self.mask).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.some[(h & self.mask).astype(np.int64)])
        if len(self.keys) and len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out


def _tokens(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending and document of each token, each text followed by END; and the place of each text's first token."""
    docs = len(b.first) - 1
    n = np.diff(b.first)
    at = np.arange(len(b.start)) + np.repeat(np.arange(docs), n)
    h = np.full(len(b.start) + docs, END, np.uint64)
    h[at] = b.hashes()
    ending = np.full(len(h), -1, np.int32)
    ending[at] = endings(b)
    return h, ending, np.repeat(np.arange(docs), n + 1), b.first[:-1] + np.arange(docs)


def _aggregated(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _gatherer(buckets: int, keys_of: Callable[[Batch], tuple[np.ndarray, np.ndarray | None]], salt: int) -> Callable:
    """Counts 64-bit keys over a task's batches and sends (key, count[, tag of the key]) by bucket."""

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            key, count = _aggregated([k for k, _, _ in held], [c for _, c, _ in held])
            arrays = [key, count.astype(np.int64)]
            if held[0][2] is not None:
                every, tag = np.concatenate([k for k, _, _ in held]), np.concatenate([t for _, _, t in held])
                order = np.argsort(every, kind="stable")
                arrays.append(tag[order][np.searchsorted(every[order], key)])
            yield from exchange.pack((mix(key, salt) % np.uint64(buckets)).astype(np.int64), arrays)

        for rb in rows:
            for _, _, b in batches(rb.column(0), lower=True, limit=2 << 20):
                keys, tag = keys_of(b)
                key, first, count = np.unique(keys, return_index=True, return_counts=True)
                held.append((key, count, tag[first] if tag is not None else None))
                size += len(key)
                if size > FLUSH:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return gather


@dataclass
class ClassModel:
    """What a task needs to score: all of bounded size but the vocabulary, which is a table (h, n, ending, cls)."""

    unit_words: np.ndarray  # sorted hashes of the words that are units
    classes: np.ndarray  # class of each unit word, each ending, and END
    transitions: np.ndarray  # log10 P(class | class before)
    words: np.ndarray  # log10 (N_c + smooth * (V_c + 1)) of each class
    head: np.ndarray  # sorted hashes of the frequent words
    head_counts: np.ndarray
    tokens: int
    distinct: int
    likelihood: list[float]
    vocabulary: DataFrame


def _units_of(h: np.ndarray, ending: np.ndarray, unit: Lookup) -> np.ndarray:
    at = unit(h)
    n = len(unit.keys)
    return np.where(at >= 0, at, np.where(ending < 0, n + ENDINGS, n + ending))


def _likelihood(n: np.ndarray) -> float:
    f = lambda x: float(np.sum(x * np.log(np.maximum(x, 1))))
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def _frequent(vocabulary: DataFrame, about: int) -> DataFrame:
    """About so many of the most frequent words: all over a count, and of those near it a share by hash.

    The counts' logarithms, cut to at most some thousand steps, give the place; so no task sends its own top words.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    words = vocabulary.where("ending >= 0").withColumn("_step", step)
    room, at, share = about, 0, 1.0
    for r in sorted(words.groupBy("_step").count().collect(), key=lambda r: -r["_step"]):
        at, share = r["_step"], min(1.0, room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    near = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20))
    return words.where((F.col("_step") > at) | ((F.col("_step") == at) & near)).select("h", "n")


def exchange_pass(left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Move each movable unit to its best class. left[u, c]: tokens of class c before u; right: after; own: u after u."""
    classes = classes.copy()
    k = left.shape[1]
    n = np.zeros((k, k))
    np.add.at(n, classes, right)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for u in movable.tolist():
        a, s = classes[u], float(own[u])
        l, r = left[u].astype(float), right[u].astype(float)
        l[a] -= s
        r[a] -= s
        total = l.sum() + s
        if total == 0 and r.sum() == 0:
            continue
        n[:, a] -= l
        n[a, :] -= r
        n[a, a] -= s
        np.maximum(n, 0, out=n)  # contexts are those of the pass before
        rows, columns = n.sum(1) + l, n.sum(0) + r  # neighbours' tokens count whatever u's class
        cl, cr = np.flatnonzero(l), np.flatnonzero(r)
        into, out = f(n[cl] + l[cl, None]) - f(n[cl]), f(n[:, cr] + r[cr]) - f(n[:, cr])
        gain = into.sum(0) + out.sum(1) - (f(rows + r.sum() + s) - f(rows)) - (f(columns + total) - f(columns))
        diagonal = np.diagonal(n)
        gain += f(diagonal + l + r + s) - f(diagonal) - (f(diagonal + l) - f(diagonal)) - (f(diagonal + r) - f(diagonal))
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9:
            b = a
        classes[u] = b
        n[:, b] += l
        n[b, :] += r
        n[b, b] += s
    return classes


def train(
    docs: DataFrame, ws: Workspace, classes: int = CLASSES, passes: int = PASSES, units: int = UNITS, head: int = HEAD, text_col: str = "text"
) -> ClassModel:
    """Learn from every row of docs. Null texts count as empty ones: one END each."""
    texts = docs.select(text_col)
    buckets = bucket_count(texts, text_col)

    def words(b: Batch) -> tuple[np.ndarray, np.ndarray]:
        h, ending, _, _ = _tokens(b)
        return h, ending.astype(np.int16)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        key, count, ending = exchange.unpack(pdf, np.uint64, np.int64, np.int16)
        order = np.argsort(key, kind="stable")
        key, count, ending = key[order], count[order], ending[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return pd.DataFrame({"h": signed(key[first]), "n": np.add.reduceat(count, first), "ending": ending[first]})

    sent = texts.mapInArrow(_gatherer(buckets, words, 3), exchange.schema(3))
    vocabulary = ws.save(sent.groupBy("bucket").applyInPandas(total, "h long, n long, ending short"), "words")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = _frequent(vocabulary, max(units, head)).toPandas().sort_values(["n", "h"], ascending=[False, True])  # a bounded number
    top_h = top["h"].to_numpy(np.int64).view(np.uint64)
    unit_words = np.sort(top_h[:units])
    order = np.argsort(top_h)
    head_h, head_n = top_h[order], top["n"].to_numpy(np.int64)[order]
    rank = np.empty(len(unit_words), np.int64)
    rank[np.searchsorted(unit_words, top_h[:units])] = np.arange(len(unit_words))
    all_units = len(unit_words) + ENDINGS + 1
    # END stays in class 0; the others begin dealt by rank
    assigned = np.concatenate([1 + rank % (classes - 1), 1 + np.arange(ENDINGS) % (classes - 1), [0]])

    def pairs(b: Batch) -> tuple[np.ndarray, None]:
        h, ending, _, first = _tokens(b)
        u = _units_of(h, ending, Lookup(unit_words)).astype(np.uint64)
        before = np.empty(len(u), np.uint64)
        before[1:] = u[:-1]
        before[first] = all_units - 1
        return before * np.uint64(1 << 20) + u, None

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        key, count = _aggregated(*[[x] for x in exchange.unpack(pdf, np.uint64, np.int64)])
        return pd.DataFrame({"v": (key >> np.uint64(20)).astype(np.int32), "w": (key & np.uint64((1 << 20) - 1)).astype(np.int32), "n": count})

    sent = texts.mapInArrow(_gatherer(buckets, pairs, 5), exchange.schema(2))
    bigrams = ws.save(sent.groupBy("bucket").applyInPandas(added, "v int, w int, n long"), "bigrams")  # units squared at most

    def contexts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit by class counts, before and after, and of a unit after itself: a matrix of fixed size."""

        def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((all_units, 2 * classes + 1), np.int64)
            flat = m.reshape(-1)
            for rb in rows:
                v, w, n = (rb.column(i).to_numpy() for i in range(3))
                width = 2 * classes + 1
                for at in (w.astype(np.int64) * width + of[v], v.astype(np.int64) * width + classes + of[w]):
                    np.add.at(flat, at, n)
                same = v == w
                np.add.at(flat, v[same].astype(np.int64) * width + 2 * classes, n[same])
            some = np.flatnonzero(m.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(m[some].astype("<i8")), pa.list_(pa.int64()))], ["u", "m"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            u, m = pdf["u"].to_numpy(), np.stack(pdf["m"].to_list())
            own, place = np.unique(u, return_inverse=True)
            out = np.zeros((len(own), m.shape[1]), np.int64)
            np.add.at(out, place, m)
            return pd.DataFrame({"u": own, "m": list(out)})

        parts = min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = bigrams.coalesce(parts).mapInArrow(count, "u long, m array<long>")
        got = rows.groupBy(F.pmod("u", F.lit(parts)).alias("g")).applyInPandas(add, "u long, m array<long>").toPandas()
        out = np.zeros((all_units, 2 * classes + 1), np.int64)
        if len(got):
            out[got["u"].to_numpy()] = np.stack(got["m"].to_list())
        return out[:, :classes], out[:, classes : 2 * classes], out[:, -1]

    likelihood: list[float] = []
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for turn in range(passes + 1):
        left, right, own = contexts(assigned)
        n = np.zeros((classes, classes))
        np.add.at(n, assigned, right)
        likelihood.append(_likelihood(n))
        if best is None or likelihood[-1] > best[0]:
            best = (likelihood[-1], assigned, n)
        if turn == passes:
            break
        movable = np.flatnonzero(left.any(1) | right.any(1))
        movable = movable[movable < all_units - 1]
        if turn:  # halves in turn, so that neighbours don't move past each other
            movable = movable[(mix(movable.astype(np.uint64), 29) + np.uint64(turn)) % np.uint64(2) == 0]
        movable = movable[np.argsort(-right[movable].sum(1), kind="stable")]
        assigned = exchange_pass(left, right, own, assigned, movable)
    _, assigned, n = best
    transitions = np.log10((n + SMOOTH_CLASS) / (n.sum(1, keepdims=True) + SMOOTH_CLASS * classes))

    @F.pandas_udf("int")
    def class_of(h: pd.Series, ending: pd.Series) -> pd.Series:
        u = _units_of(h.to_numpy(np.int64).view(np.uint64), ending.to_numpy(np.int32), Lookup(unit_words))
        return pd.Series(assigned[u].astype(np.int32))

    sizes = vocabulary.select("n", class_of("h", "ending").alias("c")).groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    total_c, distinct_c = np.zeros(classes), np.zeros(classes)
    total_c[sizes["c"]], distinct_c[sizes["c"]] = sizes["n"], sizes["v"]
    return ClassModel(
        unit_words, assigned, transitions, np.log10(total_c + SMOOTH_WORD * (distinct_c + 1)), head_h, head_n,
        int(sums["n"] or 0), int(sums["v"]), likelihood, vocabulary,
    )


def score(docs: DataFrame, model: ClassModel, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as (id_col, n_tokens, n_known, train_tokens, base_score, score), log10 sums over its tokens and END.

    base_score is of the unigram model with 0.1 added to each count. A null or empty text is END alone.
    Repeated rows and null ids are scored like any others. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    buckets = bucket_count(source, "_text")
    m = model
    unit_words, classes, transitions, sums, head, counts = m.unit_words, m.classes, m.transitions, m.words, m.head, m.head_counts
    end_row = m.vocabulary.where("ending = -1").agg(F.sum("n")).first()[0] or 0
    norm = np.log10(m.tokens + SMOOTH_WORD * (m.distinct + 1))
    kind = docs.schema[id_col].dataType.simpleString()

    def local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums that need no vocabulary, and the other words of each document: their hashes and counts."""
        unit, frequent = Lookup(unit_words), Lookup(head)
        log_counts = np.log10(counts + SMOOTH_WORD)
        log_end, known_end = np.log10(end_row + SMOOTH_WORD), end_row > 0
        for rb in rows:
            for lo, hi, b in batches(rb.column(1), lower=True, limit=2 << 20):
                h, ending, doc, first = _tokens(b)
                docs_ = hi - lo
                c = classes[_units_of(h, ending, unit)]
                before = np.empty(len(c), np.int64)
                before[1:] = c[:-1]
                before[first] = 0
                at = frequent(h)
                is_end = ending < 0
                held = at >= 0
                logs = np.zeros(len(h))
                logs[held] = log_counts[at[held]]
                logs[is_end] = log_end
                total = lambda x, doc=doc, n=docs_: np.bincount(doc, weights=x, minlength=n)
                n = np.bincount(doc, minlength=docs_)
                fixed = total(transitions[before, c] - sums[c])
                known = total(held | (is_end & known_end)).astype(np.int64)
                rare = np.flatnonzero(~held & ~is_end)
                key = h[rare]
                order = np.lexsort((key, doc[rare]))
                key, of = key[order], doc[rare][order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(key))).astype("<u4")
                key, of = key[start].astype("<u8"), of[start]
                cut = np.searchsorted(of, np.arange(docs_ + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rb.column(0).slice(lo, docs_), pa.array(n, pa.int64()), pa.array(known), pa.array(total(logs)), pa.array(fixed),
                        pa.array([key[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                        pa.array([times[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                    ],
                    ["_id", "n", "known", "logs", "fixed", "keys", "times"],
                )

    rows = source.mapInArrow(local, f"_id {kind}, n long, known long, logs double, fixed double, keys binary, times binary")
    rows = ws.save(rows.withColumn("_uid", F.monotonically_increasing_id()), "local")

    def ask(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch:
            uid = rb.column(0).to_numpy()
            keys, times = rb.column(1).to_pylist(), rb.column(2).to_pylist()
            lo = 0
            while lo < len(keys):
                hi, size = lo, 0
                while hi < len(keys) and (size == 0 or size < FLUSH):
                    size += len(keys[hi]) // 8
                    hi += 1
                key = np.frombuffer(b"".join(keys[lo:hi]), "<u8")
                of = np.repeat(uid[lo:hi], [len(x) // 8 for x in keys[lo:hi]])
                yield from exchange.pack(
                    (mix(key, 3) % np.uint64(buckets)).astype(np.int64), [key, of, np.frombuffer(b"".join(times[lo:hi]), "<u4")]
                )
                lo = hi

    def known_words(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batch:
            key, n = rb.column(0).to_numpy().view(np.uint64), rb.column(1).to_numpy()
            yield from exchange.pack((mix(key, 3) % np.uint64(buckets)).astype(np.int64), [key, n])

    def answer(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        h, of, times = exchange.unpack(asked, np.uint64, np.int64, np.uint32)
        words, n = exchange.unpack(known, np.uint64, np.int64)
        order = np.argsort(words)
        words, n = words[order], n[order]
        at = Lookup(words)(h)
        count = np.where(at >= 0, n[np.maximum(at, 0)] if len(n) else 0, 0)
        ids, place = np.unique(of, return_inverse=True)
        return pd.DataFrame({
            "_uid": ids, "known": np.bincount(place, weights=times * (count > 0), minlength=len(ids)).astype(np.int64),
            "logs": np.bincount(place, weights=times * np.log10(count + SMOOTH_WORD), minlength=len(ids)),
        })

    asked = rows.where("octet_length(keys) > 0").select("_uid", "keys", "times").mapInArrow(ask, exchange.schema(3))
    known = m.vocabulary.where("ending >= 0").select("h", "n").mapInArrow(known_words, exchange.schema(2))
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(answer, "_uid long, known long, logs double")
    back = answers.groupBy("_uid").agg(F.sum("known").alias("more_known"), F.sum("logs").alias("more_logs"))
    out = rows.drop("keys", "times").join(back, "_uid", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"), (logs - F.col("n") * F.lit(float(norm))).alias("base_score"), (logs + F.col("fixed")).alias("score"),
    )


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10, **settings) -> DataFrame:
    """Train on the rows that are not held out and score every row: score()'s columns and held_out."""
    ws = Workspace(docs.sparkSession, "class-lm")
    model = train(docs.where(~is_held_out(F.col(id_col), buckets)), ws, text_col=text_col, **settings)
    held = is_held_out(F.col(id_col), buckets)
    return score(docs, model, ws, id_col, text_col).select(id_col, held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
