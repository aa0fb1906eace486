import random
import re

import pytest
from lodestack.operators import search
from lodestack.operators.index import SearchIndex
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, at long, tags array<string>"
STORED = {"source": "string", "at": "bigint", "tags": "array<string>"}


def rows(seed, n, start=0):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "the", "the", "of", "Of", "x9", "été"] + [f"w{i}" for i in range(40)]
    return [
        (start + i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 3, 20, 200]))) if rng.random() > 0.03 else None, f"s{i % 3}", rng.randrange(5), [f"T{i % 2}", "all"])
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    data = rows(1, 300) + rows(2, 200, 1000)
    index = SearchIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i", stored=STORED, buckets=4)
    assert index.add(spark.createDataFrame(data[:300], SCHEMA)) == 300
    assert index.add(spark.createDataFrame(data[250:], SCHEMA)) == 200  # known ids are left out
    return index, data


PAGES = [("the", 3, 0, {}), ("alpha the", 5, 4, {}), ("of-of", 500, 0, {}), ("the of-Of w3", 4, 1, {"tag": ("tags", "t1")}), ("nowhere alpha", 9, 0, {}), (" . ", 5, 2, {"namespace": ("source", "s1")}), ("w1-w2-w3 été", 9, 0, {}), ("the-the alpha", 2, 0, {"namespace": ("source", "s1"), "tag": ("tags", "ALL")})]


@pytest.mark.parametrize("query,limit,offset,more", PAGES)
def test_pages_are_those_of_a_scan(spark, built, query, limit, offset, more):
    index, data = built
    want = search.page(spark.createDataFrame(data, SCHEMA), query, limit=limit, offset=offset, created="at", **more).collect()
    assert [tuple(r) for r in index.page(query, limit=limit, offset=offset, created="at", **more).collect()] == [tuple(r) for r in want]


def test_counts(spark, built):
    index, data = built
    has = lambda t, w: w in (t or "").lower().replace("-", " ").replace("\n", " ").split(" ")
    assert index.count("the").first()[0] == sum(has(r[1], "the") for r in data)
    assert index.count("the", namespace=("source", "s2")).first()[0] == sum(has(r[1], "the") and r[2] == "s2" for r in data)
    assert index.count().first()[0] == len(data)


def test_only_the_terms_buckets_and_best_layers_are_read(spark, built):
    index, _ = built
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = index.postings.among(["alpha"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in plan
    read = index.postings.among(["alpha"]).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < index.postings.read().select(F.input_file_name().alias("f")).distinct().count()
    plan = index.page("the", limit=2, created="at")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*layer", plan) and "text:string" not in plan


def test_removal_and_return(spark, tmp_path):
    data = rows(5, 120)
    index = SearchIndex(spark, f"file://{tmp_path}/i", stored=STORED, buckets=3)
    docs = spark.createDataFrame(data, SCHEMA)
    index.add(docs)
    assert index.remove(docs.where("doc_id < 50")) == 50 and index.remove(docs.where("doc_id < 10")) == 0
    new = [(i, "alpha the again", "s9", 1, []) for i in range(5)]
    assert index.add(spark.createDataFrame(new, SCHEMA)) == 5
    left = spark.createDataFrame(data[50:] + new, SCHEMA)
    for q in ("alpha the", "the-again", None):
        want = [tuple(r) for r in search.page(left, q, limit=30, created="at").collect()]
        assert [tuple(r) for r in index.page(q, limit=30, created="at").collect()] == want
    reopened = SearchIndex(spark, index.path, stored=STORED, buckets=3)
    assert reopened.count("alpha").first() == index.count("alpha").first()


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, f"file://{tmp_path}/i", stored=STORED, buckets=2)
    docs = spark.createDataFrame(rows(8, 40), SCHEMA)
    monkeypatch.setattr(SearchIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.add(docs)
    monkeypatch.undo()
    assert index.count("the").first()[0] == 0 and index.page("the", created="at").count() == 0
    assert index.add(docs) == 40
    want = [tuple(r) for r in search.page(docs, "the", created="at").collect()]
    assert [tuple(r) for r in index.page("the", created="at").collect()] == want


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", stored=STORED, buckets=2)
    assert index.add(spark.createDataFrame([], SCHEMA)) == 0
    assert index.page("the", created="at").count() == 0 and index.page(created="at").count() == 0


def test_spread_postings_have_a_task_for_each_bucket_and_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestack.operators.index.WRITTEN", 200)
    monkeypatch.setattr("lodestack.operators.index.TOGETHER", 50)
    data = spark.createDataFrame(rows(4, 60), SCHEMA)
    index = SearchIndex(spark, f"file://{tmp_path}/i", stored=STORED, buckets=2)
    index.add(data)
    files = index.postings.read().select(F.input_file_name().alias("f"), F.pmod(F.hash("term"), F.lit(2)).alias("b"), "layer").distinct()
    assert files.groupBy("f").count().where("count > 1").count() == 0
    assert files.where("layer = 3").count() > 2  # more tasks than buckets
    want = [tuple(r) for r in search.page(data, "the", created="at").collect()]
    assert [tuple(r) for r in index.page("the", created="at").collect()] == want
