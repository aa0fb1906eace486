import difflib
import math
import unicodedata

from pyspark.sql import functions as F

from lodestack.functions import texts
from lodestack.operators import catalog, runs, search


def _found(df):
    return [tuple(r) for r in df.collect()]


def test_a_page_follows_phrases_filters_and_bounds(spark):
    texts = ["of of of x", "of x of", "Of-OF was", None, "", "was of of", "of of"]
    rows = spark.createDataFrame([(i, t, i % 2, ["En", "b%"] if i < 6 else None) for i, t in enumerate(texts)], "doc_id long, text string, created_at int, tags array<string>")
    assert search.phrases('  "Of-of" was ?? of-of ') == ["of of", "was"] and search.phrases(None) == search.phrases(" ? ") == []
    n, mean = len(texts), sum(len((t or "").replace("-", " ").split()) for t in texts) / len(texts)
    idf = max(1e-6, math.log((n - 4 + 0.5) / 4.5))
    bm25 = lambda f, size: round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)), 10)
    ranks = {0: bm25(2, 4), 2: bm25(1, 3), 5: bm25(1, 3), 6: bm25(1, 2)}
    order = sorted(ranks, key=lambda i: (-ranks[i], -(i % 2), i))
    assert _found(search.page(rows, "of-of")) == [(i, ranks[i]) for i in order]
    assert _found(search.page(rows, "of-of", limit=0, offset=-3)) == [(order[0], ranks[order[0]])]
    assert _found(search.page(rows, "of-of", tag=("tags", "eN"), namespace=("created_at", 0))) == [(i, ranks[i]) for i in order if i in (0, 2)]
    assert [i for i, _ in _found(search.page(rows, " "))] == [1, 3, 5, 0, 2, 4, 6]
    assert _found(search.page(rows, "of-of nowhere")) == _found(search.page(rows.limit(0), "of")) == []


def test_sides_are_compared_by_means_of_rounded_means(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 10, 2), (1, "a", 0.0, 11, 1), (1, "b", 1.0, 40, 2), (2, "b", 0.5, 20, 1), (2, "c", 9.0, 9, 9)], "k int, side string, rate double, tokens int, passed int")
    got = runs.compare_summary(rows, "k", "side", "a", "b", "rate", "tokens", "passed").first()
    assert (got["a_rate"], got["a_tokens"], got["a_passed"], got["b_rate"], got["b_tokens"], got["b_passed"]) == (0.25, 5.3, 1.5, 0.75, 30.0, 3.0)
    assert (got["a_tokens_each"], got["b_tokens_each"], got["token_ratio"], got["winner"]) == (3.5, 10.0, 5.7143, "a")
    none = runs.compare_summary(rows.limit(0), "k", "side", "a", "b", "rate", "tokens", "passed").first()
    assert (none["a_rate"], none["a_tokens_each"], none["token_ratio"], none["winner"]) == (0.0, None, 0.0, "tie")


def test_benchmarks_of_one_arm(spark):
    rows = spark.createDataFrame([("x", True, 1.0, 10, 4), ("y", False, 1.0, 10, 4), ("z", True, 0.5, 10, 1), ("z", False, 0.5, 10, 2)], "skill string, own boolean, rate double, tokens int, tools int")
    got = {r["skill"]: r for r in runs.benchmark_summary(rows, "skill", F.col("own"), "rate", "tokens", "tools").collect()}
    assert (got["x"]["process"], got["x"]["efficiency"], got["x"]["passed"], got["x"]["trade"], got["x"]["overall"]) == (1.0, 0.5, True, None, 0.875)
    assert (got["y"]["process"], got["y"]["efficiency"], got["y"]["passed"], got["y"]["trade"]) == (0.0, 0.5, False, "REJECT")
    assert (got["z"]["process"], got["z"]["efficiency"], got["z"]["passed"], got["z"]["trade"]) == (0.5, 1.0, True, "PARETO_BETTER")


def test_files_beside_a_skill(spark):
    rows = spark.createDataFrame(
        [(1, "README.md", "x", False), (2, "scripts/a.py", "", False), (3, "scripts/a.py", "#!x", False), (4, "scripts/a.js", "x", False), (5, "a.py", "x", False), (6, "r.MD", "\n" * 101, True), (7, "r.md", "\n" * 100, True),
         (8, "r.md", "\n" * 49 + "## Contents" + "\n" * 99, True), (9, "r.md", "\n" * 50 + "## Contents" + "\n" * 99, True), (10, "r.md", "\n" * 101, False), (11, "scripts/b/a.sh", None, True)],
        "id int, path string, text string, referenced boolean")
    got = _found(catalog.file_findings(rows, ["id"], F.col("path"), F.col("text"), F.col("referenced")))
    assert sorted(got) == [(1, "STR-016"), (2, "STR-017"), (6, "QLT-008"), (9, "QLT-008")]


def test_the_nearest_config_is_within_the_levels(spark):
    rows = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b"), (3, "/a"), (4, "/x"), (5, ""), (6, None), (7, "/a/bb")], "id int, folder string")
    configs = spark.createDataFrame([("/a/b", "p"), ("", "root"), ("/a/b/c/d", "q")], "folder string, config string")
    assert dict(catalog.nearest_config(rows, configs, "id", "folder").select("id", "config").collect()) == {1: "p", 2: "p", 3: "root", 4: "root", 5: "root", 6: None, 7: "root"}
    assert dict(catalog.nearest_config(rows, configs, "id", "folder", levels=1).select("id", "config").collect()) == {1: None, 2: "p", 3: None, 4: None, 5: "root", 6: None, 7: None}


def test_texts_are_folded_and_compared(spark):
    said = ["\uff45\uff56\uff41\uff4c(x)", "\U0001d41e\U0001d42f\U0001d41a\U0001d425", "\u0435val", "eval", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("t", texts.compatibility_folded("t").alias("f")).collect()
    assert [r["f"] for r in rows] == [t and unicodedata.normalize("NFKC", t) if t else t for t in said]
    pairs = [("a\nb\nc\n", "a\nx\nc\n"), ("a", "a"), (None, "a\n"), ("a\n", None), (None, None), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", texts.unified_diff("a", "b").alias("d")).collect()
    assert all(r["d"] == "".join(difflib.unified_diff((r["a"] or "").splitlines(True), (r["b"] or "").splitlines(True), "old", "new")) for r in got)


def test_means_of_means_do_not_depend_on_the_order_of_additions(spark):
    # 30 rounded means whose exact sum, 120.8175, halves a last place when divided
    means = [4.0] * 28 + [4.4, 4.4175]
    rows = [(i, "a", m) for i, m in enumerate(means)] + [(i, "b", -m) for i, m in enumerate(means)]
    for k in (1, 7, 200):
        got = runs.side_by_side(spark.createDataFrame(rows[::-1] if k == 7 else rows, "k long, side string, v double").repartition(k), "k", "side", "v", "a", "b").where("k IS NULL").first()
        assert (got["a"], got["b"]) == (4.0273, -4.0273)
    none = runs.side_by_side(spark.createDataFrame([], "k long, side string, v double"), "k", "side", "v", "a", "b").collect()
    assert [tuple(r) for r in none] == [(None, None, None)]
