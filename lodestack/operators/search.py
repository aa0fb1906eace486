"""Full-text search over a catalogue, ranked by BM25 (the weight of a term that most texts have is held to 1e-6), in two passes with map-side counts."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != F.lit(""))


def bm25(docs: DataFrame, query: Sequence[str], limit: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The `limit` best (id_col, rank) of texts that hold every term; ties by id. One aggregate row passes the driver's broadcast."""
    query = list(dict.fromkeys(t.lower() for t in query))

    def times(term: str) -> Column:
        return F.size(F.filter("_w", lambda w: w == F.lit(term)))

    words = terms(F.col(text_col))
    counted = docs.select(id_col, words.alias("_w")).select(
        id_col, F.size("_w").alias("_n"), *[times(t).alias(f"_f{i}") for i, t in enumerate(query)]
    )
    stats = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(query))])
    found = counted.where(" AND ".join(f"_f{i} > 0" for i in range(len(query))) or "false").crossJoin(F.broadcast(stats))  # a single row
    rank = F.lit(0.0)
    for i in range(len(query)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)))
        f = F.col(f"_f{i}")
        rank = rank + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    return found.select(id_col, F.round(rank, 10).alias("rank")).orderBy(F.desc("rank"), id_col).limit(limit)


def phrases(query: str | None) -> list[str]:
    """The phrases of a query: parts between white space, each one or more terms joined by a space. Parts without a term are left out."""
    parts = (" ".join(re.findall("[a-z0-9]+", part.lower())) for part in (query or "").split())
    return [p for p in dict.fromkeys(parts) if p]


def page(
    docs: DataFrame, query: str | None = None, namespace: tuple[str, str] | None = None, tag: tuple[str, str] | None = None, limit: int = 50, offset: int = 0,
    id_col: str = "doc_id", text_col: str = "text", created: str = "created_at", most: int = 500, k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """A page (id_col, rank) of texts that hold every phrase of query, best first, later ones before earlier ones of equal rank, then by id.

    namespace is (column, value), tag (column of an array, member, compared without case). Ranks are of the whole table, whatever the filters leave.
    A blank query finds all rows, the latest first, with a null rank. limit is held to 1..most, offset to 0..100000.
    """
    wanted, rank = phrases(query), F.lit(None).cast("double")
    keep = docs.select(id_col, created, text_col, *[f[0] for f in (namespace, tag) if f and f[0] not in (id_col, created, text_col)])
    if wanted:
        words = terms(F.col(text_col))
        padded = keep.withColumn("_n", F.size(words)).withColumn("_s", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
        keep = padded.select(*[c for c in keep.columns if c != text_col], "_n", *[F.regexp_count("_s", F.lit(f"(?= {p} )")).alias(f"_f{i}") for i, p in enumerate(wanted)])
        stats = keep.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(wanted))])
        keep = keep.where(" AND ".join(f"_f{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))  # a single row
        rank = F.lit(0.0)
        for i in range(len(wanted)):
            idf = F.greatest(F.lit(1e-6), F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)))
            rank = rank + idf * F.col(f"_f{i}") * (k1 + 1) / (F.col(f"_f{i}") + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    if namespace:
        keep = keep.where(F.col(namespace[0]) == namespace[1])
    if tag:
        keep = keep.where(F.exists(F.col(tag[0]), lambda t: F.lower(t) == tag[1].lower()))
    found = keep.select(id_col, F.round(rank, 10).alias("rank"), F.col(created).alias("_at")).orderBy(F.desc("rank"), F.desc("_at"), id_col)
    return found.offset(min(max(offset, 0), 100_000)).limit(min(max(limit, 1), most)).select(id_col, "rank")
