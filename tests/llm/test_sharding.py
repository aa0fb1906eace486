import zlib

import pytest

from lodestack.llm.sharding import shard


def rows(n):
    for i in range(n):
        yield (i, "copy of one text" * 20 if i % 3 == 0 else f"text {i // 2} " * (1 + i % 17), i)


def check(out, source, shards):
    by_id = {i: t for i, t, *_ in source}
    assert sorted(r["doc_id"] for r in out) == sorted(by_id)
    for r in out:
        data = (by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    for s in range(shards):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return [sum(r["size"] for r in out if r["shard"] == s) for s in range(shards)]


def test_shards_are_near_equal_with_a_hot_group(spark):
    source = list(rows(6000))
    out = shard(spark.createDataFrame(source, "doc_id long, text string, size int"), shards=8, samples_per_range=4).collect()
    loads = check(out, source, 8)
    assert max(loads) - min(loads) <= 2 * max(r["size"] for r in out) + 0.02 * sum(loads) / 8
    where = {}
    for r in out:
        where.setdefault(r["key"], set()).add(r["shard"])
    small = [v for k, v in where.items() if sum(r["key"] == k for r in out) < 3]
    assert all(len(v) == 1 for v in small)  # small groups of copies stay together


def brute(rows, shards):
    """(id, shard, slot) by one pass over all rows in the order of (key, id)."""
    rows = sorted(rows, key=lambda r: (r["key"], r["doc_id"]))
    total, group, start, at = sum(r["size"] for r in rows), {}, {}, 0
    for r in rows:
        group[r["key"]] = group.get(r["key"], 0) + r["size"]
        start.setdefault(r["key"], at)
        r["at"] = at
        at += r["size"]
    filled, out = {}, []
    for r in rows:
        whole = group[r["key"]] * 100 * shards <= total
        middle = start[r["key"]] + group[r["key"]] / 2 if whole else r["at"] + r["size"] / 2
        s = min(shards - 1, int(middle * shards / total))
        out.append((r["doc_id"], s, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + 1
    return sorted(out)


@pytest.mark.parametrize(("each", "per_range"), [(16, 500_000), (1, 50)])
def test_matches_brute_force(spark, each, per_range):
    docs = spark.createDataFrame(list(rows(3000)), "doc_id long, text string, size int")
    out = [r.asDict() for r in shard(docs, shards=7, ranges_per_shard=each, rows_per_range=per_range, samples_per_range=6).collect()]
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in out) == brute(out, 7)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert shard(spark.createDataFrame([], schema), shards=3).count() == 0
    source = [(1, None), (2, ""), (3, "é" * 100_000), (4, "a"), (5, "a")]
    check(shard(spark.createDataFrame(source, schema), shards=3).collect(), source, 3)
    twice = shard(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], schema), shards=2).collect()
    assert len(twice) == 3 and {(r["shard"], r["slot"]) for r in twice} == {(r["shard"], i) for r in twice for i in [r["slot"]]}
