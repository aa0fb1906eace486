"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

Documents are sets of distinct k-word shingles. Documents with equal sets form a class, told apart by two
64-bit digests of the set, and only classes are joined. Sizes are cut into bands so that a linked pair is in
one band or in neighbouring bands; in the schema of the lower band such a pair differs in at most H elements.
The schema hashes the universe into m segments and indexes the subset of each, and for d of them also the
one-deletion neighbourhood of the subset. A set allocates to each segment 0 (it isn't looked up), 1 (its
subset) or 2 (its subset and one-deletion neighbourhood, against the same of others), H + 1 in all: if a
partner missed every segment, it would differ in at least as many elements as each has, more than H in all.
The allocation is by cost: the cheapest steps first. A step costs the number of sets that have its keys, where
those are many; else a subset costs less the larger it is. Empty subsets, which a share of all sets have in
common, are never looked up; and a passage that many documents share is looked up by none that can do without. A set that can't reach H + 1 without them goes on to the next
level, where the universe is hashed anew; it stays indexed at the levels before, so partners that stopped there
find it. After the last level come H + 1 segments looked up whatever they hold.

Before that, classes that can have no partner are dropped by a bound on necessary elements. A set of n elements
has at most e(n) = floor((1 - threshold) * n) that a linked set lacks, so the j-th smallest common hash is among
the e(n) + j smallest of each. Each set sends its e(n) + l(n) smallest, l(n) being a tenth of n; so linked sets
share at least l(smaller size) of those sent, and a class that shares fewer with all others together is dropped.

Each set also has a parity sketch: how many of its elements fall to each of 512 places, modulo 2. Sketches of
two sets differ in at most as many places as the sets do in elements, so a pair whose sketches differ in more
than a link allows is left out before it is made. This bound is exact: it drops no link.

Pairs are verified on the words of their texts, and links are contracted to components at once. First each set
is compared with one partner a round, so near copies gather into components by as many pairs as there are sets.
Then keys that two components share are settled: sets that look a key up are its pivots, those of its smallest
components first, and are compared with all members of others, more of them each round, until no key has a pair
left. No key, pair or partner is capped.
A task sends a key that many of its sets share once, so a hot key is no hot bucket.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import exchange
from lodestack.llm.components import merge_components
from lodestack.llm.textarrays import LOWER_BYTES, Batch, batches, mix, signed, window_hashes
from lodestack.llm.workspace import Workspace, attach, buckets_for

#: Related pairs that a set is expected to meet, in written keys: what avoiding one is worth in a schema.
PAIR_COST = 20.0
#: Records that a task packs at once; bounds its memory.
FLUSH = 1_500_000
#: A set of n sends n // EXTRA necessary elements more than a linked set may lack.
EXTRA = 10
#: A schema lets its sets allocate this many times what they need, so that they can do without some segments.
SLACK = 1.4
#: Whole subsets that as many sets have are looked up last.
HOT = 256
#: Times that the universe is hashed anew for sets that can't allocate enough.
LEVELS = 8
#: Rounds in which each set is compared with one partner.
GATHER = 2
#: Longs of a parity sketch.
PARITY = 8
SKETCH = [f"p{i}" for i in range(PARITY)]
#: Flags of a key's record: the whole subset of the set (else one element is left out); the set looks it up.
WHOLE, PROBE = 1, 2
#: Pairs of one pivot that a task verifies, about.
PAIRS_EACH = 512
#: Parts into which members of a key are dealt when they meet its pivots.
SALTS = 16
_LOW32 = (1 << 32) - 1


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Elements at each of 64 * PARITY places modulo 2, as longs."""
    counts = np.bincount((mix(s, 17) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _windows(b: Batch, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Shingle hashes of each document in order; fewer than k words are one shingle; no words, none."""
    h = b.hashes(seed)
    w = window_hashes(h, k, seed)
    for a, e in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
        yield w[a : e - k + 1] if e - a >= k else window_hashes(h[a:e], e - a, seed) if e > a else h[:0]


def shingle_sets(b: Batch, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    return map(np.unique, _windows(b, k))


def set_digests(b: Batch, k: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each document's sorted distinct shingle hashes, and two digests of the set, of independent word hashes."""
    for one, two in zip(_windows(b, k), _windows(b, k, 1), strict=True):
        s, at = np.unique(one, return_index=True)
        yield s, int(np.add.reduce(mix(s, 1))), int(np.add.reduce(mix(two[at], 2)))


def bands(num: int, den: int, largest: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band: sizes that link with its lowest are in it or below its end."""
    out, lo = [], 1
    while lo <= max(1, largest):
        hi = max(lo, lo * den // num)
        out.append((lo, hi))
        lo = hi + 1
    return out


def choose_schema(lo: int, hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(m, d, H + 1) of the band of sizes lo to hi: the cheapest that lets nearly all its sets allocate H + 1."""
    needed = hi * (den - num) // num + 1
    best = None
    for m in sorted({max(1, needed * i // 12) for i in range(6, 25)}):
        size = lo / m
        none, one = math.exp(-size), size * math.exp(-size)
        for d in sorted({m * i // 8 for i in range(9)}):
            least = m * (1 - none) + d * (1 - none - one)
            spread = math.sqrt(m * none * (1 - none) + d * (none + one) * (1 - none - one))
            short = lo > 1 and max(0.0, SLACK * needed - (least - 3 * spread))
            meet = m * none + d * one  # expected keys that a pair with half its elements in common shares
            cost = (short, m + d * size + PAIR_COST * meet)
            if m + d >= needed and (best is None or cost < best[0]):
                best = (cost, m, d)
    return best[1], best[2], needed


def choose_schemas(sizes: list[tuple[int, int]], num: int, den: int) -> list[tuple[int, int, int]]:
    """(m, d, H + 1) of each band."""
    return [choose_schema(lo, hi, num, den) for lo, hi in sizes]


def allocate(first: np.ndarray, second: np.ndarray, needed: int) -> np.ndarray | None:
    """0, 1 or 2 for each segment, `needed` in all, by the costs of the first and second step; None if that can't be.

    An infinite cost bars a step. A second step costs more than the first.
    """
    steps = np.concatenate([first, second])
    order = np.argsort(steps, kind="stable")[:needed]
    if len(order) < needed or not np.isfinite(steps[order[-1]]):
        return None
    return np.bincount(order % len(first), minlength=len(first))


def segment_keys(s: np.ndarray, band: int, m: int, d: int, needed: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set in a schema, and their flags. hot: sorted keys that many sets have, and how many."""
    keys, flags = [], []
    weight = mix(s, 7)

    def load(key: np.ndarray) -> np.ndarray:
        if hot is None or not len(hot[0]):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
        return np.where(hot[0][at] == key, hot[1][at], 0)

    for level in range(LEVELS + 1):
        last = level == LEVELS
        if last:
            m, d = needed, 0
        seg = (((mix(s, 100 + level) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(seg, minlength=m)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, weight)
        sums += mix(np.arange(m, dtype=np.uint64) + np.uint64((band << 32) + (level << 24)), 11)
        few = np.flatnonzero((seg < d) & (counts[seg] > 1))
        at = seg[few]
        whole, less = mix(sums, 13), mix(sums[at] - weight[few], 13)
        if last:
            share = np.ones(m, np.int64)
        else:
            rare = np.exp(-counts.astype(float))
            first = np.where(counts > 0, rare + load(whole), np.inf)
            more = counts * rare + np.bincount(at, weights=load(less), minlength=m)
            share = allocate(first, np.where((counts > 1) & (np.arange(m) < d), first + more, np.inf), needed)
        some = np.arange(m) if last else np.flatnonzero(counts)
        probe = np.zeros(m, np.int64) if share is None else share
        keys += [whole[some], less]
        flags += [WHOLE + PROBE * (probe[some] > 0), PROBE * (probe[at] > 1)]
        if share is not None:
            break
    return np.concatenate(keys), np.concatenate(flags).astype(np.uint8)


def lacking(n: int, num: int, den: int) -> int:
    """Elements of a set of n that a linked set may lack."""
    return n * (den - num) // den


def extra(n: int, num: int, den: int) -> int:
    """Necessary elements that a set of n sends beyond those that a linked set may lack. Rises with n."""
    return min(max(1, n // EXTRA), n - lacking(n, num, den))


def _extra(n: Column, num: int, den: int) -> Column:
    return F.least(F.greatest(F.lit(1), F.floor(n / EXTRA)), n - F.floor(n * (den - num) / den))


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Records sorted by their columns, without repeats."""
    order = np.lexsort(columns[::-1])
    out = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in out])
    return [x[new] for x in out]


def _firsts(run: np.ndarray) -> np.ndarray:
    first = np.ones(len(run), bool)
    first[1:] = run[1:] != run[:-1]
    return first


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x, 3) % np.uint64(buckets)).astype(np.int64)


#: Kinds of a record of necessary elements: one set's; one of several sets', counted by its task; the count of a task for a set.
LONE, SHARED, COUNT = 0, 1, 2


def _send_elements(key: np.ndarray, s1: np.ndarray, s2: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    key, s1, s2 = _distinct(key, s1, s2)
    run = exchange.runs(key)
    many = np.bincount(run)[run] > 1
    order = np.lexsort((s2[many], s1[many]))
    place = exchange.runs(s1[many][order], s2[many][order])
    sets, count = _distinct(s1[many], s2[many]), np.bincount(place)
    send = _firsts(run)  # a key that several sets of the batch share goes once
    kind = np.where(many[send], SHARED, LONE)
    records = [
        np.concatenate([key[send], count.astype(np.uint64)]), np.concatenate([s1[send], sets[0]]), np.concatenate([s2[send], sets[1]]),
        np.concatenate([kind, np.full(len(count), COUNT)]).astype(np.uint8),
    ]
    yield from exchange.pack(_bucket(np.concatenate([key[send], sets[0]]), buckets), records)


def _added(s1: np.ndarray, s2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of a set added up."""
    order = np.lexsort((s2, s1))
    s1, s2, n = s1[order], s2[order], n[order]
    first = _firsts(exchange.runs(s1, s2))
    return s1[first], s2[first], np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n


def _count_elements(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """(s1, s2, shared), packed by the set's bucket: how many of a set's necessary elements another set of the bucket has too, and counts passed on."""
    key, s1, s2, kind = exchange.unpack(pdf, np.uint64, np.uint64, np.uint32, np.uint8)
    done = kind == COUNT
    counted = key[done].astype(np.int64), s1[done], s2[done]
    key, s1, s2, kind = (x[~done] for x in (key, s1, s2, kind))
    order = np.lexsort((s2, s1, key))
    key, s1, s2, kind = (x[order] for x in (key, s1, s2, kind))
    run = exchange.runs(key)
    new = _firsts(exchange.runs(key, s1, s2))
    several = (np.bincount(run, weights=new) > 1) | (np.bincount(run, weights=kind == SHARED) > 0)
    keep = new & several[run] & (kind == LONE)  # a set that two tasks have counted for a key counts twice: never too few
    counts = _added(np.concatenate([s1[keep], counted[1]]), np.concatenate([s2[keep], counted[2]]), np.concatenate([np.ones(int(keep.sum()), np.int64), counted[0]]))
    rows = [x.to_pandas() for x in exchange.pack(_bucket(counts[0], buckets), counts)]
    return rows[0] if rows else pd.DataFrame({c: [] for c in ("bucket", "c0", "c1", "c2")})


def _sum_elements(pdf: pd.DataFrame) -> pd.DataFrame:
    """(s1, s2, shared) of each set of a bucket, once."""
    s1, s2, n = _added(*exchange.unpack(pdf, np.uint64, np.uint32, np.int64))
    return pd.DataFrame({"s1": signed(s1), "s2": s2.astype(np.int64), "shared": n})


def _send_partners(key: np.ndarray, sid: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys to their buckets, once a batch, by their least set and the number of sets; the others have that set as partner already."""
    key, sid = _distinct(key, sid)
    run = exchange.runs(key)
    first = _firsts(run)
    rest, partner = sid[~first], sid[first][run][~first]
    count = np.concatenate([np.bincount(run), np.zeros(len(rest), np.int64)]).astype(np.int32)  # 0: a partner is told
    records = [np.concatenate([key[first], partner.view(np.uint64)]), np.concatenate([sid[first], rest]), count]
    yield from exchange.pack(np.concatenate([_bucket(key[first], buckets), _bucket(rest.view(np.uint64), buckets)]), records)


def _partners_and_hot(pdf: pd.DataFrame) -> pd.DataFrame:
    """(hot, id, partner, n). Not hot: of a bucket's whole subsets, the smaller set with which set id shares the most. Hot: a key that n sets have."""
    key, sid, count = exchange.unpack(pdf, np.uint64, np.int64, np.int32)
    told = count == 0
    own, mate = sid[told], key[told].view(np.int64)
    key, sid, count = key[~told], sid[~told], count[~told]
    order = np.lexsort((sid, key))
    key, sid, count = key[order], sid[order], count[order]
    run = exchange.runs(key)
    first = _firsts(run)
    total = np.bincount(run, weights=count).astype(np.int64)
    hot = total >= HOT
    least = sid[first][run]
    other = sid != least
    own, mate = np.concatenate([own, sid[other]]), np.concatenate([mate, least[other]])
    order = np.lexsort((mate, own))
    own, mate = own[order], mate[order]
    starts = np.flatnonzero(_firsts(exchange.runs(own, mate)))
    n = np.diff(np.append(starts, len(own)))
    own, mate = own[starts], mate[starts]
    order = np.lexsort((mate, -n, own))
    own, mate, n = own[order], mate[order], n[order]
    best = _firsts(exchange.runs(own))
    return pd.DataFrame({
        "hot": np.repeat([False, True], [int(best.sum()), int(hot.sum())]), "id": np.concatenate([own[best], signed(key[first][hot])]),
        "partner": np.concatenate([mate[best], np.zeros(int(hot.sum()), np.int64)]), "n": np.concatenate([n[best], total[hot]]),
    })


def _send_components(key: np.ndarray, component: np.ndarray, flags: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    records = _distinct(key, component, flags)
    yield from exchange.pack(_bucket(records[0], buckets), records)


def _open_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keys that two components share, one of them by a whole subset and one looking it up."""
    key, component, flags = exchange.unpack(pdf, np.uint64, np.int64, np.uint8)
    order = np.lexsort((component, key))
    key, component, flags = key[order], component[order], flags[order]
    run = exchange.runs(key)
    first = _firsts(run)
    keep = np.bincount(run, weights=_firsts(exchange.runs(key, component))) > 1
    for flag in (WHOLE, PROBE):
        keep &= np.bincount(run, weights=flags & flag > 0) > 0
    return pd.DataFrame({"key": signed(key[first][keep])})


def similarity_classes(
    docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of docs as (id_col, n_shingles, component_id). Sets link when den * |A & B| >= num * |A | B|.

    component_id is the smallest id reachable by links, a document's own if it has none. Texts that are null
    or without words have no shingles, no links, and their own id. Rows are told apart by their sets, not by
    their ids: rows with one id and different texts are different documents. A null id has a component like any
    row, and links others, but never names one; where all ids of a component are null, it is null.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard-join")
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tag"), F.xxhash64(text_col, F.lit(1)).alias("_tag2"), F.col(text_col).alias("_text"))

    def describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            n, s1, s2, parity = [], [], [], [np.zeros((0, PARITY), np.int64)]
            for _, _, b in batches(rb.column(3), lower=True):
                for s, one, two in set_digests(b, k):
                    n.append(len(s))
                    parity.append(parity_sketch(s)[None, :])
                    s1.append(one)
                    s2.append(two)
            places = np.concatenate(parity)
            yield pa.RecordBatch.from_arrays(
                [*rb.columns[:3], pa.array(n, pa.int64()), *[pa.array(signed(np.array(x, np.uint64))) for x in (s1, s2)], *[pa.array(places[:, i]) for i in range(PARITY)]],
                ["_id", "_tag", "_tag2", "n", "s1", "s2", *SKETCH],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    described = ws.save(source.mapInArrow(describe, f"_id {kind}, _tag long, _tag2 long, n long, s1 long, s2 long, " + ", ".join(f"{p} long" for p in SKETCH)), "sets")

    total, shingles = described.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = buckets_for(spark, (shingles or 0) * ((den - num) / den + 1 / EXTRA) * 21)

    def elements(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rb in rows:
            for _, _, b in batches(rb.column(0), lower=True):
                for s, one, two in set_digests(b, k):
                    if len(s):
                        e = s[: lacking(len(s), num, den) + extra(len(s), num, den)]
                        held.append((e, np.full(len(e), one, np.uint64), np.full(len(e), two & _LOW32, np.uint32)))
                        size += len(e)
                if size > FLUSH:
                    yield from _send_elements(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size = [], 0
        if held:
            yield from _send_elements(*map(np.concatenate, zip(*held, strict=True)), buckets)

    packed = source.select("_text").mapInArrow(elements, exchange.schema(4))
    # a set has a count in each bucket that shares an element of it, up to as many as it sends: packed, they are no rows of their own
    counts = packed.groupBy("bucket").applyInPandas(lambda pdf: _count_elements(pdf, buckets), exchange.schema(3))
    shared = counts.groupBy("bucket").applyInPandas(_sum_elements, "s1 long, s2 long, shared long").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "shared")
    classes = described.where("n > 0").groupBy("s1", "s2").agg(
        F.min("_id").alias("low"), F.coalesce(F.min_by("_tag", "_id"), F.min("_tag")).alias("t"), F.coalesce(F.min_by("_tag2", "_id"), F.min_by("_tag2", "_tag")).alias("t2"),
        F.max("n").alias("n"), *[F.max(p).alias(p) for p in SKETCH],
    )
    smallest = F.ceil(F.col("n") * num / den)  # of a linked set
    same = (F.col("s1") == F.col("_s1")) & (F.col("s2").bitwiseAND(_LOW32) == F.col("_s2"))
    classes = classes.join(shared, same).where(F.col("shared") >= _extra(smallest, num, den))
    classes = ws.save(classes.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "low", "t", "t2", "n", *SKETCH), "classes")

    # the text of one document of each class that is left
    of = (F.col("_tag") == F.col("t")) & (F.col("_tag2") == F.col("t2")) & F.col("_id").eqNullSafe(F.col("low"))
    texts = source.join(classes.select("sid", "low", "t", "t2"), of).dropDuplicates(["sid"])
    texts = ws.save(texts.select("sid", F.col("_text").alias("text")), "texts")
    labels = _linked(classes, texts, k, num, den, ws)

    part = labels.join(classes.select(F.col("sid").alias("id"), "s1", "s2", "low"), "id").withColumn("component", F.col("component").cast("string").cast("binary"))
    lows = part.groupBy("component").agg(F.min("low").alias("_low"), F.count(F.lit(1)).alias("c")).where("c > 1")
    named = attach(part, ws.save(lows, "lows"), "component", "c", classes.count(), "id").select("s1", "s2", "_low")
    every = described.where("n > 0").groupBy("s1", "s2").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")).join(named, ["s1", "s2"], "left")
    every = every.select(_set_key("s1", "s2").alias("_set"), F.coalesce("_low", "least").alias("component"), "copies", "least")
    named = ws.save(every.where("copies > 1 OR NOT component <=> least").drop("least"), "named")
    alone = F.concat(F.lit("none:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")
    keyed = described.select("_id", "n", F.when(F.col("n") > 0, _set_key("s1", "s2")).otherwise(alone).alias("_set"))
    done = attach(keyed, named, "_set", "copies", total, "_id")
    return done.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def _linked(classes: DataFrame, texts: DataFrame, k: int, num: int, den: int, ws: Workspace) -> DataFrame:
    """(id, component) of every class: components of the links between them."""
    largest, shingles = classes.agg(F.max("n"), F.sum("n")).first()
    sizes = bands(num, den, largest or 1)
    buckets = buckets_for(texts.sparkSession, (shingles or 0) * 2.5 * 17)  # a key for each element and segment, in two schemas
    ends = np.array([hi for _, hi in sizes])
    schemas = choose_schemas(sizes, num, den)  # some hundred bands at most: sizes grow geometrically

    def records(rows: Iterator[pa.RecordBatch], emit: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        """emit(keys, flags, ids) of every FLUSH keys of rows (text, id, hot, times)."""
        held, size = [], 0
        for rb in rows:
            own = rb.column(1).to_numpy()
            for lo, _, b in batches(rb.column(0), lower=True):
                for x, s in enumerate(shingle_sets(b, k), lo):
                    band = int(np.searchsorted(ends, len(s)))
                    hot = None
                    if rb.column(2)[x].is_valid:
                        hot = np.array(rb.column(2)[x].as_py(), np.int64).view(np.uint64), np.array(rb.column(3)[x].as_py(), np.int64)
                        order = np.argsort(hot[0])
                        hot = hot[0][order], hot[1][order]
                    for schema in {band, max(0, band - 1)}:
                        key, flags = segment_keys(s, schema, *schemas[schema], hot)
                        held.append((key, flags, np.full(len(key), own[x])))
                        size += len(key)
                if size > FLUSH:
                    yield from emit(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held, strict=True)))

    def to_partner(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return records(rows, lambda key, flags, sid: _send_partners(key[flags & WHOLE > 0], sid[flags & WHOLE > 0], buckets))

    def to_component(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return records(rows, lambda key, flags, component: _send_components(key, component, flags, buckets))

    def to_member(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, flags, sid):
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[part])), pa.array(sid[part]), pa.array(flags[part].astype(np.int32))], ["key", "sid", "flags"])

        return records(rows, emit)

    about = classes.select("sid", "n", *SKETCH)
    mate = classes.select(F.col("sid").alias("pivot"), F.col("n").alias("pn"), *[F.col(p).alias(f"pivot_{p}") for p in SKETCH])
    apart = reduce(Column.__add__, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"pivot_{p}"))) for p in SKETCH])
    may_link = (apart * (den + num) <= (den - num) * (F.col("n") + F.col("pn"))) & (F.least("n", "pn") * den >= F.greatest("n", "pn") * num)

    labels = classes.select(F.col("sid").alias("id"), F.col("sid").alias("component"))
    checked: DataFrame | None = None

    def compare(pairs: DataFrame) -> bool:
        """Verify pairs (pivot, sid) and merge what links; whether anything did."""
        nonlocal labels, checked
        pairs = pairs.select("pivot", "sid").distinct().withColumn("a", F.least("sid", "pivot")).withColumn("b", F.greatest("sid", "pivot"))
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        now = ws.save(_verified(ws.save(pairs.select("pivot", "sid"), "pairs"), texts, k, num, den, ws), "verified")
        done = now.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b"), "linked")
        checked = done.select("a", "b") if checked is None else checked.union(done.select("a", "b"))
        before, labels = labels, merge_components(labels, done.where("linked"), ws)
        return labels is not before

    unknown = [F.lit(None).cast("array<long>").alias(c) for c in ("hot", "times")]
    first = texts.select("text", "sid", *unknown).mapInArrow(to_partner, exchange.schema(3)).groupBy("bucket").applyInPandas(
        _partners_and_hot, "hot boolean, id long, partner long, n long"
    )
    first = ws.save(first, "partners")
    partners = first.where("NOT hot").groupBy(F.col("id").alias("sid"), "partner").agg(F.sum("n").alias("n")).groupBy("sid").agg(F.max_by("partner", "n").alias("pivot"))
    compare(partners.join(about, "sid").join(mate, "pivot").where(may_link))

    own_keys = texts.select("text", "sid", *unknown).mapInArrow(to_member, "key long, sid long, flags int")
    hot = own_keys.join(first.where("hot").select(F.col("id").alias("key"), "n"), "key").groupBy("sid").agg(F.collect_list(F.struct("key", "n")).alias("hot"))
    placed = texts.join(ws.save(hot, "hot-keys"), "sid", "left").join(labels.withColumnRenamed("id", "sid"), "sid")
    placed = ws.save(placed.select("text", "sid", "component", F.col("hot.key").alias("hot"), F.col("hot.n").alias("times")), "placed")
    keys = placed.select("text", "component", "hot", "times").mapInArrow(to_component, exchange.schema(3)).groupBy("bucket").applyInPandas(_open_keys, "key long")
    members = placed.select("text", "sid", "hot", "times").mapInArrow(to_member, "key long, sid long, flags int")
    members = ws.save(members.join(ws.save(keys, "open-keys"), "key").select("key", "sid", "flags"), "members")

    def still_open(members: DataFrame) -> DataFrame:
        """members with component, of keys that two components share and a member looks up."""
        at = members.join(labels.withColumnRenamed("id", "sid"), "sid")
        unlike = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.bit_or("flags").alias("z"))
        unlike = unlike.where("x <> y").where(F.col("z") == (WHOLE | PROBE))
        return ws.save(at.join(unlike.select("key"), "key"), "open")

    at = still_open(members)
    for turn in range(GATHER):  # each set with one member of the largest component of its keys
        if at.limit(1).count() == 0:
            return labels
        order = F.col("sid").bitwiseXOR(F.lit(int(mix(np.array([turn]), 19)[0] >> np.uint64(1))))
        groups = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by("sid", order).alias("pivot"))
        largest = groups.groupBy("key").agg(F.max_by("pivot", "c").alias("pivot"), F.max_by("component", "c").alias("own"))
        met = at.join(largest, "key").where("component <> own").groupBy("sid", "pivot").agg(F.count(F.lit(1)).alias("c"))
        met = met.join(about, "sid").join(mate, "pivot").where(may_link).groupBy("sid").agg(F.max_by("pivot", "c").alias("pivot"))
        if not compare(met):
            break
        ws.drop(at)
        at = still_open(members)

    pivots_each = 4
    for _ in itertools.count():
        if at.limit(1).count() == 0:
            return labels
        share = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy("key").orderBy("c", "component", "sid")
        pivots = at.where(F.col("flags").bitwiseAND(PROBE) > 0).join(share, ["key", "component"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots_each)
        pivots = ws.save(pivots.select("key", F.col("sid").alias("pivot"), F.col("component").alias("own"), F.col("flags").alias("pf")), "pivots")
        dealt = pivots.join(mate, "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = at.join(about, "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
        either = F.col("flags").bitwiseOR(F.col("pf")) == (WHOLE | PROBE)
        compare(spread.join(dealt, ["key", "salt"]).where("component <> own").where(either & may_link))
        # pivots have met every other component of their keys, so they leave them
        members = ws.save(at.join(pivots.select("key", F.col("pivot").alias("sid")), ["key", "sid"], "left_anti").select("key", "sid", "flags"), "members")
        ws.drop(at, pivots)
        at = still_open(members)
        pivots_each *= 8


def _set_key(*columns: str) -> Column:
    return F.concat_ws(":", *columns).cast("binary")


def _word_set(text: str, k: int) -> set[bytes]:
    w = text.encode().translate(LOWER_BYTES).split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, ws: Workspace) -> DataFrame:
    """(pivot, sid, linked) of every pair, decided on the words of both texts. A pivot of many pairs is dealt to several tasks."""
    many = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PAIRS_EACH).cast("int").alias("parts")).where("parts > 1")
    many = ws.save(many, "busy-pivots")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    parts = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
    right = pairs.join(many, "pivot", "left").withColumn("part", part).join(texts.select("sid", F.col("text").alias("ts")), "sid")
    left = texts.withColumnRenamed("sid", "pivot").join(pairs.select("pivot").distinct(), "pivot", "left_semi").join(many, "pivot", "left")
    left = left.select("pivot", F.explode(parts).alias("part"), F.col("text").alias("tp"))
    joined = right.join(left, ["pivot", "part"]).select("pivot", "sid", "tp", "ts")

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, set[bytes]] = (None, set())
        for rb in rows:
            linked = []
            for a, ta, tb in zip(rb.column(0).to_pylist(), rb.column(2), rb.column(3), strict=True):
                if held[0] != a:
                    held = (a, _word_set(ta.as_py(), k))
                x, y = held[1], _word_set(tb.as_py(), k)
                both = len(x & y)
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(linked, pa.bool_())], ["pivot", "sid", "linked"])

    return joined.mapInArrow(check, "pivot long, sid long, linked boolean")
