import hashlib

from lodestack.llm.exact_dedup import DigestIndex, dedup

ROWS = [(1, "Same Text", 7), (2, "same text", 8), (3, "SAME TEXT", 9), (4, None, 1), (5, "", 2), (6, "ÄB", 3), (7, "äb", 4), (8, "x " * 200_000, 5)]
SCHEMA = "doc_id long, text string, digest int"


def normal(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_matches_brute_force_and_ignores_clashing_columns(spark):
    out = {r["doc_id"]: r for r in dedup(spark.createDataFrame(ROWS, SCHEMA), DigestIndex(spark, buckets=3)).collect()}
    for i, t, _ in ROWS:
        group = [j for j, u, _ in ROWS if normal(u) == normal(t)]
        r = out[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), i == max(group))
        assert bytes(r["digest"]).hex() == hashlib.sha256(normal(t).encode()).hexdigest()
    assert len(out) == len(ROWS)


def test_second_batch_loses_against_the_index(spark):
    index = DigestIndex(spark, buckets=3)
    dedup(spark.createDataFrame(ROWS, SCHEMA), index).count()
    new = dedup(spark.createDataFrame([(20, "SAME text", 0), (21, "new", 0), (22, "new", 0)], SCHEMA), index)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in new.collect()} == {(20, 3, False), (21, 22, False), (22, 22, True)}
    assert index.table().count() == len({normal(t) for _, t, _ in ROWS}) + 1
    assert index.table().groupBy("digest").count().where("count > 1").count() == 0


def test_batches_of_one_call_meet_in_the_index(spark):
    rows = [(i, f"t{i % 7}" if i % 2 else f"T{i % 5}", 0) for i in range(60)] + [(None, "t1", 0), (None, "alone", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r["doc_id"]), bytes(r["digest"]), r["keep_id"], r["group_size"], r["kept"])
    once, twice = (sorted(map(key, dedup(docs, DigestIndex(spark), cuts=c).collect()), key=str) for c in ((), (20, 45)))
    assert once == twice and sum(k[-1] for k in once) == len({normal(t) for _, t, _ in rows})


def test_an_index_keeps_its_buckets(spark):
    index = DigestIndex(spark, buckets=3)
    dedup(spark.createDataFrame(ROWS, SCHEMA), index).count()
    again = DigestIndex(spark, index.name, buckets=5)
    assert again.buckets == 3
    assert [r["kept"] for r in dedup(spark.createDataFrame([(9, "same text", 0)], SCHEMA), again).collect()] == [False]
    again.drop()
    assert not index.exists()


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a", 0), (1, "a", 0), (1, "A", 0), (None, "b", 0), (None, "b", 0)]
    out = dedup(spark.createDataFrame(rows, SCHEMA), DigestIndex(spark)).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in out) == [("1", False), ("1", False), ("1", True), ("None", False), ("None", True)]


def test_empty_table_and_null_ids(spark):
    assert dedup(spark.createDataFrame([], SCHEMA), DigestIndex(spark)).count() == 0
    out = dedup(spark.createDataFrame([(None, "a", 1), (3, "a", 1)], SCHEMA), DigestIndex(spark)).collect()
    assert {(r["doc_id"], r["kept"]) for r in out} == {(None, False), (3, True)}


def test_hot_group_stays_whole(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", 0) for i in range(3000)]
    out = dedup(spark.createDataFrame(rows, SCHEMA), DigestIndex(spark)).collect()
    assert len(out) == 3000 and sum(r["kept"] for r in out) == 1001
    assert {r["group_size"] for r in out if r["doc_id"] % 3} == {2000}


def test_query_takes_ids_whose_sum_is_no_long(spark, tmp_path):
    from lodestack.llm.queries import op4_exact_dedup

    rows = [(5 * 10**18, "a", 0), (6 * 10**18, "A", 0), (-(2**63), "b", 0), (2**63 - 1, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in op4_exact_dedup(spark, str(tmp_path)).collect()} == {(5 * 10**18, 6 * 10**18, False), (6 * 10**18, 6 * 10**18, True), (-(2**63), -(2**63), True), (2**63 - 1, 2**63 - 1, True)}
