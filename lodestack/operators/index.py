"""A persistent inverted index: searches read the postings of their terms, never a text.

Tables under one path, each row with the batch that wrote it; a batch counts once its row of totals is there, so one
that broke off leaves nothing that a search sees. Batches are numbered, so an index has one writer at a time:

- postings (term, ids, counts, places): bucketed by term, in folders by layer. A row holds the texts with a term that one
  task met together: how often each has it, and the term's positions in them, one text's after another's. A text's layer
  is the power of four below its number of terms.
- stats (term, layer, texts, most): texts of a layer that hold a term, and its largest count in one.
- entries (id, n, layer, stored columns): bucketed by id, in folders by layer.
- totals (texts, terms) and removed (id): an id that is removed hides the rows of earlier batches.

Ranking is BM25 as in search.page. A layer's bound is the rank of a text of the least n that it can have with the largest counts; layers
are read in order of their bounds until they hold as many texts as are asked for, then only those whose bound reaches
the last rank found. So common terms cost a few layers of their postings, and the driver holds a row for each layer
(about ten) and term of the query.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.search import phrases, terms
from lodestack.sources.tables import Bucketed, remove_folder

#: Terms of texts whose postings one task writes, about, and whose postings are laid together: they bound what a task sorts and holds.
WRITTEN, TOGETHER = 2_000_000, 500_000


def _layer(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1))) / 2).cast("int")


def _laid(ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """(term, layer, ids, counts, places) of a few texts: their terms sorted by (term, layer), each text's in order."""
    flat, bounds = words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    layer = np.maximum(np.frexp(np.maximum(n, 1))[1] - 1, 0) // 2  # the power of two below n, halved
    key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 64 + layer[text]
    order = np.argsort(key, kind="stable")
    key, text = key[order], text[order]
    place = (order - (bounds[:-1] - bounds[0])[text]).astype(np.int32)
    row = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    posting = np.union1d(row, np.flatnonzero(np.diff(text)) + 1)
    first, of_row = posting[:-1], pa.array(np.searchsorted(posting, row), pa.int32())
    lists = lambda ends, values: pa.ListArray.from_arrays(ends, values)
    return pa.RecordBatch.from_arrays(
        [flat.dictionary.take(pa.array(key[row[:-1]] // 64)).cast(pa.string()), pa.array((key[row[:-1]] % 64).astype(np.int32)), lists(of_row, ids.take(pa.array(text[first]))),
         lists(of_row, pa.array(np.diff(posting).astype(np.int32))), lists(pa.array(row, pa.int32()), pa.array(place))],
        ["term", "layer", "ids", "counts", "places"],
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of texts (id, words), about TOGETHER terms at a time."""
    for batch in batches:
        ids, words = batch.column(0), batch.column(1)
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        i = 0
        while i < len(ids):
            start = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, start + TOGETHER)))
            if ends[min(j, len(ids)) - 1] > start:
                yield _laid(ids.slice(i, j - i), words.slice(i, j - i))
            i = j


class SearchIndex:
    """An index under path. id_type and stored are types of the id and of columns to filter and sort by (name: type), in DDL."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", stored: dict[str, str] | None = None, buckets: int = 32):
        self.spark, self.path, self.stored, self.buckets = spark, path, dict(stored or {}), buckets
        columns = "".join(f", `{k}` {t}" for k, t in self.stored.items())
        table = lambda name, schema, key, parts=(): Bucketed(spark, f"{path}/{name}", f"{schema}, batch string", key, buckets, parts)
        self.postings = table("postings", f"term string, ids array<{id_type}>, counts array<int>, places array<int>, layer int", "term", ("layer",))
        self.stats = table("stats", "term string, layer int, texts bigint, most bigint", "term")
        self.entries = table("entries", f"id {id_type}, n bigint, layer int{columns}", "id", ("layer",))
        self.totals = table("totals", "texts bigint, terms bigint", "batch")
        self.removed = table("removed", f"id {id_type}", "id")

    def _batches(self) -> list[str]:
        """Batches that are whole: one for each call of add and remove."""
        return [r[0] for r in self.totals.read().select("batch").collect()]

    def _next(self) -> str:
        return f"{max((int(b[:8]) for b in self._batches()), default=0) + 1:08d}-{uuid.uuid4().hex}"

    def _whole(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("batch").isin(self._batches()))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of whole batches that no later batch has removed."""
        gone = self._whole(self.removed.read())
        if gone.limit(1).count() == 0:
            return self._whole(rows)
        by = gone.groupBy(F.col("id").alias("_gone")).agg(F.max("batch").alias("_by"))
        return self._whole(rows).join(by, F.col("id") == F.col("_gone"), "left").where("_by IS NULL OR batch > _by").drop("_gone", "_by")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index the texts whose id is not there yet; returns how many. Null texts have no terms, null ids are left out; of rows with one id, that whose
        text has the least hash counts. Texts are shuffled only if an id is repeated, or if some are there already and are too many to broadcast."""
        batch = self._next()
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_w"), F.xxhash64(text_col).alias("_h"), *self.stored)
        narrow = rows.select("id", "_h", F.size("_w").cast("bigint").alias("n"), *self.stored)
        one = narrow.groupBy("id").agg(F.min_by(F.struct("n", *self.stored), "_h").alias("_e"), F.count(F.lit(1)).alias("_rows"))
        known = self._live(self.entries.read()).select(F.col("id").alias("_known"))
        one = one.join(known.hint("merge"), F.col("id") == F.col("_known"), "left")
        kept = self.path + f"/given/{batch}"
        one.select("id", "_e.*", (F.col("_rows") > 1).alias("_twice"), F.col("_known").isNotNull().alias("_there")).write.parquet(kept)
        one = self.spark.read.parquet(kept)
        self.entries.append(one.where("NOT _there").select("id", "n", _layer(F.col("n")).alias("layer"), *self.stored), same={"batch": F.lit(batch)})
        texts, words, twice, there = one.agg(F.count_if(~F.col("_there")), F.coalesce(F.sum(F.when(~F.col("_there"), F.col("n"))), F.lit(0)), F.max("_twice"), F.max("_there")).first()
        cut = rows.select("id", "_w", "_h")
        if there:
            cut = cut.join(one.where("_there").select("id"), "id", "left_anti")
        if twice:
            cut = cut.groupBy("id").agg(F.min_by("_w", "_h").alias("_w"))
        kind = rows.schema["id"].dataType.simpleString()
        found = cut.select("id", "_w").mapInArrow(_postings, f"term string, layer int, ids array<{kind}>, counts array<int>, places array<int>")
        self.postings.append(found, spread_by=F.get("ids", F.lit(0)), spread=max(1, math.ceil(words / WRITTEN / self.buckets)), same={"batch": F.lit(batch)})
        own = self.postings.read().where(F.col("batch") == batch)
        self.stats.append(own.groupBy("term", "layer").agg(F.sum(F.size("ids")).alias("texts"), F.max(F.array_max("counts")).cast("bigint").alias("most")), same={"batch": F.lit(batch)})
        self._commit(batch, texts, words)
        remove_folder(self.spark, kept)
        return texts

    def _commit(self, batch: str, texts: int, words: int) -> None:
        self.totals.append(self.spark.range(1).select(F.lit(texts).cast("bigint").alias("texts"), F.lit(words).cast("bigint").alias("terms"), F.lit(batch).alias("batch")))

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Take texts out of all searches and counts; returns how many were there. They can be added again."""
        batch = self._next()
        gone = self._live(self.entries.read()).join(ids.select(F.col(id_col).alias("id")).distinct().hint("merge"), "id", "left_semi")
        texts, words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.removed.append(gone.select("id", F.lit(batch).alias("batch")))
        own = self.removed.read().where(F.col("batch") == batch).select("id")
        # ids are hashed, so that the postings, which are far more, are not sorted
        left = self._live(self._each(self.postings.read(), False)).join(own.hint("shuffle_hash"), "id", "left_semi")
        self.stats.append(left.groupBy("term", "layer").agg((-F.count(F.lit(1))).alias("texts"), F.lit(0).cast("bigint").alias("most")), same={"batch": F.lit(batch)})
        self._commit(batch, -texts, -words)
        return texts

    def _each(self, postings: DataFrame, placed: bool) -> DataFrame:
        """(term, layer, batch, id, f): a row for each text of postings; f is its count of the term, or (placed) the term's positions in it."""
        if not placed:
            return postings.select("term", "layer", "batch", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("counts").alias("f"))))
        ends = F.aggregate("counts", F.array(F.lit(0)), lambda e, c: F.array_append(e, F.element_at(e, -1) + c))
        rows = postings.select("term", "layer", "batch", "ids", "places", "counts", ends.alias("_ends"))
        own = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.slice("places", F.get("_ends", i) + 1, F.get("counts", i)).alias("f")))
        return rows.select("term", "layer", "batch", F.inline(own))

    def _found(self, wanted: Sequence[str], layers: Sequence[int] | None) -> DataFrame:
        """(id, _f0, _f1, ...): how often each wanted phrase stands in each text that holds all of their terms. Positions are read only for phrases."""
        every, placed = sorted({t for p in wanted for t in p.split(" ")}), any(" " in p for p in wanted)
        rows = self._whole(self.postings.among(every))
        rows = rows if layers is None else rows.where(F.col("layer").isin(list(layers)))
        by = self._live(self._each(rows, placed)).groupBy("id").agg(*[F.max_by("f", F.when(F.col("term") == t, 1)).alias(f"_p{i}") for i, t in enumerate(every)])
        by = by.where(" AND ".join(f"_p{i} IS NOT NULL" for i in range(len(every))))

        def start(term: str, k: int) -> Column:
            return F.transform(F.col(f"_p{every.index(term)}"), lambda x: x - k)

        def times(phrase: str) -> Column:
            return F.size(reduce(F.array_intersect, [start(t, k) for k, t in enumerate(phrase.split(" "))])) if placed else F.col(f"_p{every.index(phrase)}")

        return by.select("id", *[times(p).alias(f"_f{i}") for i, p in enumerate(wanted)]).where(" AND ".join(f"_f{i} > 0" for i in range(len(wanted))))

    def _filtered(self, found: DataFrame | None, namespace: tuple[str, str] | None, tag: tuple[str, str] | None, layers: Sequence[int] | None = None) -> DataFrame:
        """found (None: all) with the stored columns, of entries in a namespace and with a tag."""
        entries = self.entries.read() if layers is None else self.entries.read().where(F.col("layer").isin(list(layers)))
        keep = self._live(entries).select("id", "n", *self.stored)
        if namespace:
            keep = keep.where(F.col(namespace[0]) == namespace[1])
        if tag:
            keep = keep.where(F.exists(F.col(tag[0]), lambda t: F.lower(t) == tag[1].lower()))
        return keep if found is None else found.join(keep.hint("merge"), "id")

    def page(
        self, query: str | None = None, namespace: tuple[str, str] | None = None, tag: tuple[str, str] | None = None, limit: int = 50, offset: int = 0,
        created: str = "created_at", most: int = 500, k1: float = 1.2, b: float = 0.75,
    ) -> DataFrame:
        """A page (id, rank), as search.page gives it; created and the filters' columns are among those stored."""
        limit, offset = min(max(limit, 1), most), min(max(offset, 0), 100_000)
        wanted = phrases(query)
        order = [F.desc("rank"), F.desc("_at"), "id"]
        if not wanted:
            found = self._filtered(None, namespace, tag).select("id", F.lit(None).cast("double").alias("rank"), F.col(created).alias("_at"))
            return found.orderBy(*order).offset(offset).limit(limit).select("id", "rank")
        texts, mean, df = self._weights(wanted)

        def rank(counts: Sequence[Column], n: Column) -> Column:
            total = F.lit(0.0)
            for f, d in zip(counts, df, strict=True):
                idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(texts)) - F.lit(float(d)) + 0.5) / (F.lit(float(d)) + 0.5)))
                total = total + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * n / F.lit(mean)))
            return total

        def ranked(layers: Sequence[int]) -> DataFrame:
            found = self._filtered(self._found(wanted, layers), namespace, tag, layers)
            return found.select("id", F.round(rank([F.col(f"_f{i}") for i in range(len(wanted))], F.col("n")), 10).alias("rank"), F.col(created).alias("_at"))

        bounds = self._bounds(wanted, rank)
        first, rest, held = [], [], 0
        for layer, _, least in bounds:
            (first if held < limit + offset else rest).append(layer)
            held += least
        out = ranked(first)
        if rest:
            kept = out.orderBy(*order).limit(limit + offset).agg(F.count(F.lit(1)), F.min("rank")).first()
            reach = kept[1] if kept[0] == limit + offset else None
            rest = [layer for layer, bound, _ in bounds if layer in rest and (reach is None or bound >= reach)]
        if rest:
            out = ranked(first + rest)
        return out.orderBy(*order).offset(offset).limit(limit).select("id", "rank")

    def count(self, query: str | None = None, namespace: tuple[str, str] | None = None, tag: tuple[str, str] | None = None) -> DataFrame:
        """One row (total): entries that a search without limits finds."""
        wanted = phrases(query)
        return self._filtered(self._found(wanted, None) if wanted else None, namespace, tag).agg(F.count(F.lit(1)).alias("total"))

    def _weights(self, wanted: Sequence[str]) -> tuple[int, float, list[int]]:
        """Texts, their mean number of terms, and of each phrase how many texts hold it."""
        texts, words = self._whole(self.totals.read()).agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        single = [p for p in wanted if " " not in p]
        known = {r[0]: r[1] for r in self._whole(self.stats.among(single)).groupBy("term").agg(F.sum("texts")).collect()} if single else {}
        for p in wanted:
            if " " in p:  # how many texts hold a phrase is known only from its terms' places
                known[p] = self._found([p], None).count()
        return texts, words / texts if texts else 1.0, [known.get(p, 0) for p in wanted]

    def _bounds(self, wanted: Sequence[str], rank) -> list[tuple[int, float, int]]:
        """(layer, largest rank possible, least number of texts that hold the rarest term), best first."""
        every = sorted({t for p in wanted for t in p.split(" ")})
        by = self._whole(self.stats.among(every)).groupBy("layer", "term").agg(F.sum("texts").alias("texts"), F.max("most").alias("most"))
        per = by.where("texts > 0").groupBy("layer").agg(F.count(F.lit(1)).alias("held"), F.min("texts").alias("texts"), *[F.max(F.when(F.col("term") == t, F.col("most"))).alias(f"_m{i}") for i, t in enumerate(every)])
        per = per.where(F.col("held") == len(every))
        counts = [reduce(F.least, [F.col(f"_m{every.index(t)}") for t in p.split(" ")]) if " " in p else F.col(f"_m{every.index(p)}") for p in wanted]
        bound = F.round(rank(counts, F.pow(F.lit(4), F.col("layer"))), 10)
        return [tuple(r) for r in per.select("layer", bound, "texts").orderBy(F.desc(bound)).collect()]

    def drop(self) -> None:
        for t in (self.postings, self.stats, self.entries, self.totals, self.removed):
            t.drop()
        remove_folder(self.spark, self.path)
