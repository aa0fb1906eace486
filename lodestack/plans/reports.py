"""Queries for searches by the page, comparisons, benchmarks and files beside a skill, and the same in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import rules as R
from lodestack.functions import skill_rules as S
from lodestack.functions import texts
from lodestack.operators import audit, catalog, runs, search
from lodestack.plans.catalogue import _findings_sql, _q, _t, query
from lodestack.plans.skills import _pick, _view


@query("""WITH w AS (SELECT doc_id, source, lang, n_chars, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
          c AS (SELECT doc_id, source, lang, n_chars, len(w) AS n, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'of')) AS f0, len(list_filter(w, lambda x: x = 'was')) AS f1 FROM w),
          s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
          SELECT doc_id, round(greatest(1e-6, ln((docs - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean))
                             + greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 10) AS rank
          FROM c, s WHERE f0 > 0 AND f1 > 0 AND lower(lang) = 'en' ORDER BY rank DESC, n_chars DESC, doc_id LIMIT 500 OFFSET 1""")
def search_page(spark, sf_dir):
    """A phrase and a term among texts with a tag, from the second hit on; n_chars stands for the time of creation."""
    d = _t(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return search.page(d, "Of-of  was", tag=("tags", "EN"), limit=9000, offset=1, created="n_chars")


@query("""SELECT doc_id, NULL::DOUBLE AS rank FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 50""")
def search_latest(spark, sf_dir):
    """A blank query finds the latest entries of a namespace."""
    return search.page(_t(spark, sf_dir, "documents"), "  ", namespace=("source", "src1"), created="n_chars")


_RUNS_SQL = "SELECT user_id % {n} AS k, event_type AS arm, (event_id % 11) / 10.0::DOUBLE AS rate, event_id % 97 AS tokens, event_id % 7 AS tools FROM events"


def _runs(spark, sf_dir, n):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select((F.col("user_id") % n).alias("k"), F.col("event_type").alias("arm"), (e % 11 / 10.0).alias("rate"), (e % 97).alias("tokens"), (e % 7).alias("tools"))


@query(f"""WITH r AS ({_RUNS_SQL.format(n=40)}),
          c AS (SELECT k, {', '.join(f"round(coalesce(avg({x}) FILTER (arm = '{s}'), 0.0), {d}) AS {n}_{y}" for n, s in (('a', 'purchase'), ('b', 'view')) for x, y, d in (('rate', 'rate', 4), ('tokens', 'tokens', 1), ('tools', 'passed', 1)))} FROM r GROUP BY k),
          t AS (SELECT {', '.join(f"coalesce(sum(round({n}_rate * 10000)::BIGINT)::DOUBLE / count({n}_rate) / 10000.0::DOUBLE, 0.0) AS {n}_rate, coalesce(sum(round({n}_tokens * 10)::BIGINT)::DOUBLE / count({n}_tokens) / 10.0::DOUBLE, 0.0) AS {n}_tokens, coalesce(sum(round({n}_passed * 10)::BIGINT)::DOUBLE / 10.0::DOUBLE, 0.0) AS {n}_passed" for n in 'ab')} FROM c),
          e AS (SELECT *, CASE WHEN a_passed > 0 THEN a_tokens / a_passed END AS x, CASE WHEN b_passed > 0 THEN b_tokens / b_passed END AS y FROM t)
          SELECT round(a_rate, 4) AS a_rate, round(a_tokens, 1) AS a_tokens, round(a_passed, 1) AS a_passed, round(x, 1) AS a_tokens_each, round(b_rate, 4) AS b_rate, round(b_tokens, 1) AS b_tokens,
            round(b_passed, 1) AS b_passed, round(y, 1) AS b_tokens_each, round(CASE WHEN a_tokens > 0 THEN b_tokens / a_tokens ELSE 0 END, 4) AS token_ratio,
            CASE WHEN x IS NULL AND y IS NULL THEN 'tie' WHEN x IS NULL THEN 'b' WHEN y IS NULL THEN 'a' WHEN y = 0 OR x / y > 1.05 THEN 'b' WHEN x / y < 1 / 1.05 THEN 'a' ELSE 'tie' END AS winner FROM e""")
def compare_summary(spark, sf_dir):
    return runs.compare_summary(_runs(spark, sf_dir, 40), "k", "arm", "purchase", "view", "rate", "tokens", "tools")


@query(f"""WITH r AS (SELECT * FROM ({_RUNS_SQL.format(n=25)}) WHERE arm IN ('purchase', 'view') AND NOT (k = 3 AND arm = 'view') AND NOT (k = 4 AND arm = 'purchase')),
          b AS (SELECT k, {', '.join(f"count(*) FILTER (arm = '{s}') AS n_{n}, coalesce(avg(rate) FILTER (arm = '{s}'), 0.0) AS p_{n}, coalesce(stddev_samp(rate) FILTER (arm = '{s}'), 0.0) AS s_{n}, coalesce(avg(tokens) FILTER (arm = '{s}'), 0.0) AS t_{n}, coalesce(avg(tools) FILTER (arm = '{s}'), 0.0) AS c_{n}" for n, s in (('with', 'purchase'), ('without', 'view')))} FROM r GROUP BY k),
          m AS (SELECT *, CASE WHEN n_without = 0 THEN 1.0 ELSE least(1.0, c_with / greatest(1.0, c_without)) END AS process, p_with / CASE WHEN t_with = 0 THEN 1 ELSE t_with END AS o,
                CASE WHEN p_without > 0 THEN p_without / CASE WHEN t_without = 0 THEN 1 ELSE t_without END ELSE 0 END AS w, p_with - p_without AS d, (t_with - t_without) / nullif(t_without, 0) * 100 AS c FROM b),
          e AS (SELECT *, CASE WHEN n_with = 0 OR n_without = 0 THEN 0.5 WHEN w = 0 THEN CASE WHEN o > 0 THEN 1.0 ELSE 0.5 END ELSE least(1.0, 2 * (o / w) / (1 + o / w)) END AS paid FROM m)
          SELECT k, round(p_with, 4) AS rate_with, round(s_with, 4) AS deviation_with, round(p_without, 4) AS rate_without, round(s_without, 4) AS deviation_without, round(d, 4) AS rate_delta,
            round(t_with - t_without, 1) AS tokens_delta, round(c_with - c_without, 1) AS tools_delta, round(p_with, 4) AS outcome, round(process, 4) AS process, round(p_with, 4) AS style, round(paid, 4) AS efficiency,
            round((p_with * 2 + process + paid) / 4, 4) AS overall, CASE WHEN t_without > 0 THEN CASE WHEN d <= -0.05 THEN 'REJECT' WHEN d >= 0 AND c <= 0 THEN 'PARETO_BETTER' WHEN d > 0 AND c > 0 THEN 'TRADEOFF'
              WHEN d <= 0 AND c < 0 THEN 'CHEAPER_BUT_WEAKER' ELSE 'PARETO_WORSE' END END AS trade, d >= 0 AND p_with >= 0.5 AS passed FROM e""")
def benchmark_summary(spark, sf_dir):
    """Runs with and without each skill; skill 3 has no runs without it, skill 4 none with it."""
    r = _runs(spark, sf_dir, 25).where("arm IN ('purchase', 'view') AND NOT (k = 3 AND arm = 'view') AND NOT (k = 4 AND arm = 'purchase')")
    return runs.benchmark_summary(r, "k", F.col("arm") == "purchase", "rate", "tokens", "tools")


_BESIDE = f"""SELECT doc_id, {_pick('path', ["'README.md'", "'scripts/a.py'", "'scripts/b/c.sh'", "'scripts/d.js'", "'ref.MD'", "'ref/long.md'", "'notes.py'"])},
    {_pick('t', ["text", "concat(chr(35), '!/bin/sh', chr(10), text)", "concat(text, repeat(chr(10), 101))", "concat(chr(35), ' TOC', repeat(chr(10), 150), text)", "concat(repeat(chr(10), 120), 'Table of Contents')"])} FROM documents"""


@query(f"""SELECT doc_id, unnest(list_filter([CASE WHEN path = 'README.md' THEN 'STR-016' END, CASE WHEN regexp_matches(path, '^scripts/.*\\.(?:py|sh)$') AND NOT starts_with(t, '#!') THEN 'STR-017' END,
           CASE WHEN doc_id % 3 > 0 AND regexp_matches(path, '(?i)\\.md$') AND len(string_split(t, chr(10))) > 101 AND NOT
             regexp_matches(array_to_string(string_split_regex(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')[:50], chr(10)), {_q(S.CONTENTS)}) THEN 'QLT-008' END],
           lambda x: x IS NOT NULL)) AS code FROM ({_BESIDE})""")
def skill_file_findings(spark, sf_dir):
    return catalog.file_findings(_view(spark, sf_dir, _BESIDE, "documents"), ["doc_id"], F.col("path"), F.col("t"), F.col("doc_id") % 3 > 0)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_partkey % 50 % 2 = 0 THEN 'deep' ELSE 'brand' END WHEN p_size % 3 = 1 THEN 'brand' ELSE 'root' END AS config FROM part""")
def nearest_configs(spark, sf_dir):
    """Settings of the nearest folder above: some brands' own folders have one, every brand, and the root."""
    key = (F.col("p_partkey") % 50).cast("string")
    folder = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/b/"), key, F.lit("/s/x"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/b/"), key, F.lit("/t"))).otherwise(F.lit("/c/d"))
    folders = _t(spark, sf_dir, "part").select("p_partkey", folder.alias("folder"))
    brands = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k")).distinct()
    name = lambda s: F.concat(F.lit("/b/"), F.col("k").cast("string"), F.lit(s)).alias("folder")
    configs = brands.select(name(""), F.lit("brand").alias("config")).union(brands.where("k % 2 = 0").select(name("/s"), F.lit("deep"))).union(spark.createDataFrame([("", "root")], "folder string, config string"))
    return catalog.nearest_config(folders, configs, "p_partkey", "folder").select("p_partkey", "config")


_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789().=_-"


@query(f"""WITH {_findings_sql(R.SECRETS + R.CODE).replace("FROM documents)", "FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'eval(x)' WHEN 1 THEN 'pickle.loads(x)' ELSE text END AS text FROM documents))")} SELECT * FROM f""")
def folded_findings(spark, sf_dir):
    """Rules on texts after compatibility folding; letters, digits and some marks of the texts are full-width before it."""
    said = F.when(F.col("doc_id") % 3 == 0, "eval(x)").when(F.col("doc_id") % 3 == 1, "pickle.loads(x)").otherwise(F.col("text"))
    wide = F.translate(said, _PLAIN, "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN))
    return audit.findings(_t(spark, sf_dir, "documents").select("doc_id", texts.compatibility_folded(wide).alias("text")), R.SECRETS + R.CODE)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('--- old', chr(10), '+++ new', chr(10), '@@ -1,2 +1,2 @@', chr(10), ' x', chr(10), '-', lang, '+', source) END AS diff FROM documents""")
def text_diffs(spark, sf_dir):
    old, new = F.concat(F.lit("x\n"), "lang"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n"), "lang")).otherwise(F.concat(F.lit("x\n"), "source"))
    return _t(spark, sf_dir, "documents").select("doc_id", texts.unified_diff(old, new).alias("diff"))
