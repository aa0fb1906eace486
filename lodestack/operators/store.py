"""Content-addressed storage: dedup, fingerprints, change and regression detection, consistency."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def first_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, first_id, refs): blobs by hash; the smallest id created it. Aggregates before the shuffle, so hot blobs spread."""
    return docs.groupBy(sha256(F.col(text_col)).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("refs"))


def fingerprint(files: DataFrame, group: str, path: Column, digest: Column, chunk: int = 16_384) -> DataFrame:
    """(group, files, fingerprint): SHA-256 of "path:digest" in the order of paths. Files without a path or digest count, and add nothing.

    Ranges of the order are written as chunks of bytes in parallel; a group's chunks are then hashed in order by a task
    that holds a batch of them, never a whole group.
    """
    kind = files.schema[group].dataType.simpleString()
    keys = ["_group", "_path", "_digest"]
    rows = files.select(F.col(group).alias("_group"), path.alias("_path"), digest.alias("_digest")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # group, files, first path and digest, last path and digest, pieces; size beside it
        size = 0
        for rb in batches:
            done, of = [], rb.schema.field(0).type
            for g, p, d in zip(*(c.to_pylist() for c in rb.columns)):
                if now is None or now[0] != g or size >= chunk:
                    if now is not None:
                        done.append(now)
                    now, size = [g, 0, None, None, None, None, []], 0
                now[1] += 1
                if p is not None and d is not None:
                    if not now[6]:
                        now[2:4] = p, d
                    now[4:6] = p, d
                    now[6].append(f"{p}:{d}".encode())
                    size += len(now[6][-1])
            yield chunks(done, of)
        if now is not None:
            yield chunks([now], of)

    def chunks(done: list[list], of: pa.DataType) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*done)] or [[] for _ in range(7)]
        kinds = [of, pa.int64(), *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([b"".join(x) for x in cols[6]], pa.binary())], ["_group", "files", "a", "b", "y", "z", "bytes"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, h = None, 0, None
        for rb in batches:
            done, of = [], rb.schema.field(0).type
            for g, m, x in zip(*(c.to_pylist() for c in rb.columns)):
                if h is None or g != now:
                    if h is not None:
                        done.append((now, n, h.hexdigest()))
                    now, n, h = g, 0, hashlib.sha256()
                n += m
                h.update(x)
            yield hashes(done, of)
        if h is not None:
            yield hashes([(now, n, h.hexdigest())], of)

    def hashes(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (of, pa.int64(), pa.string()))], ["_group", "files", "fingerprint"])

    written = rows.mapInArrow(write, f"_group {kind}, files long, a string, b string, y string, z string, bytes binary")
    # equal first keys are told apart by the last: ranges don't overlap
    ordered = written.repartition("_group").sortWithinPartitions("_group", "a", "b", "y", "z").select("_group", "files", "bytes")
    return ordered.mapInArrow(digests, f"_group {kind}, files long, fingerprint string").withColumnRenamed("_group", group)


def change_set(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified or deleted between two states."""
    a, b = old.select(F.col(key), F.col(digest).alias("_a")), new.select(F.col(key), F.col(digest).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, kind.alias("change"))


def compare_findings(baseline: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status) new or resolved, with null-safe keys; repeated findings count once."""
    a, b = baseline.select(*keys).distinct(), current.select(*keys).distinct()

    def without(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select([F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return x.join(y, same, "left_anti")

    return without(b, a).withColumn("status", F.lit("new")).unionByName(without(a, b).withColumn("status", F.lit("resolved")))


def consistency(index: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """(key, problem): dangling index entries without a blob, and orphan blobs without an entry."""
    i, b = index.select(key).distinct(), blobs.select(key).distinct()
    return i.join(b, key, "left_anti").withColumn("problem", F.lit("dangling")).unionByName(b.join(i, key, "left_anti").withColumn("problem", F.lit("orphan")))


VERSION = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def semver_key(version: Column) -> Column:
    """Sortable key of MAJOR.MINOR.PATCH[-PRE][+BUILD] by semantic precedence; null where it is none.

    Numbers of any length compare by their digits' count, then their digits; in a pre-release they come before words.
    """
    number = lambda x: F.struct(F.length(x).alias("n"), x.alias("digits"))
    part = lambda i: F.regexp_extract(version, VERSION, i)
    pre = F.transform(F.split(part(4), r"\.", -1), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.when(x.rlike(r"^\d+$"), F.length(x)).otherwise(0).alias("n"), x.alias("text")))
    return F.when(version.rlike(VERSION), F.struct(*[number(part(i)).alias(f"v{i}") for i in (1, 2, 3)], (part(4) == "").alias("release"), pre.alias("pre")))


def bump(version: Column, level: Column) -> Column:
    """The next major, minor or patch version; null for what is no version or level, and for numbers of over 37 digits."""
    a, b, c = (F.regexp_extract(version, VERSION, i).try_cast("decimal(38,0)") for i in (1, 2, 3))
    joined = lambda *parts: F.when(F.least(*parts).isNotNull(), F.concat_ws(".", *[p.cast("string") for p in parts]))
    up = lambda x: F.when(x < F.lit(str(10**37)).cast("decimal(38,0)"), (x + 1).cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    return (
        F.when(~version.rlike(VERSION), None).when((level == "major") & up(a).isNotNull(), joined(up(a), zero, zero)).when((level == "minor") & up(b).isNotNull(), joined(a, up(b), zero))
        .when((level == "patch") & up(c).isNotNull(), joined(a, b, up(c)))
    )


def latest(rows: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each name. struct maxima combine before the shuffle, so a hot name is no hot task."""
    packed = F.struct(*order, F.struct(*rows.columns).alias("_row"))
    return rows.groupBy(F.col(name).alias("_name")).agg(F.max(packed).alias("_m")).select("_m._row.*")


def running(rows: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """A running total of value in each group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(value).over(w))
