"""The opN queries over whole tables, with the columns and parameters of their contracts, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import class_lm, decontaminate, exact_dedup, filter_audit, jaccard_join, license_scan, line_crf, packing, sharding, substring_dedup, token_counts, turn_repair, warc
from lodestack.llm.workspace import Workspace

#: File of the public tokenizer that packing uses.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: File of the public tokenizer whose tokens are counted, and the tokens that a context holds.
COUNTED, CONTEXT = public_tokenizers.path("byte_bpe_50k.json"), 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.similarity_classes(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that a document with a smaller id has."""
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=13)
    removed = F.aggregate("removed", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any 10-word window of a benchmark item."""
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), words=10)
    n_hit = F.size("hit").cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of documents, taken in two batches into a new digest index."""
    docs = _table(spark, sf_dir, "documents")
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  the sum of two longs may be none
    middle = docs.agg(((wide(F.min("doc_id")) + wide(F.max("doc_id"))) / 2).cast("long")).first()[0]
    # the second batch, of smaller ids, meets what the first has indexed
    index = exact_dedup.DigestIndex(spark)
    out = exact_dedup.dedup(docs, index, cuts=[] if middle is None else [middle])
    index.drop()  # the result is read from tables that dedup has written
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, equal payloads of 1000 bytes or more once, and read back."""
    path = Workspace(spark, "warc-archive").path("pages")
    out = warc.round_trip(_table(spark, sf_dir, "pages"), path, least=1000)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of documents by the class model and by its unigram base, learnt from nine tenths of them."""
    return class_lm.score_held_out(_table(spark, sf_dir, "documents"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents by their lines."""
    docs = _table(spark, sf_dir, "documents")
    field = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    out = line_crf.score(docs.select("doc_id", "text"), field)
    return out.select("doc_id", (~line_crf.may_learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in documents."""
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"])))
    return out.select(
        "doc_id", "n_blocks", F.size("findings").cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"),
        F.to_json("findings").alias("findings"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by language and in each of their orders."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents by a byte-level BPE vocabulary."""
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), COUNTED)
    return out.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of each damaged conversation."""
    return turn_repair.repair(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_class_lm": op8_class_lm,
    "op9_line_crf": op9_line_crf,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_turn_repair": op13_turn_repair,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _repair_sql() -> str:
    """Turn by turn: the cheapest (cost, audit, lines) in each state of the automaton, with what is inserted next."""

    def edit(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {state}.t || {line}) END"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} END"

    def keep(state: str, initial: str) -> str:
        return when(f"NOT bad AND starts_with(role, '{initial}')", edit(state, "cut", "K", "chr(10) || role || ':' || text"))

    def rerole(state: str, role: str) -> str:
        return when("NOT bad", edit(state, "2 + cut", "R", f"chr(10) || '{role}:' || text"))

    user, both = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
    drop = [edit(f"s{i}", "3", "D") for i in range(4)]
    n2 = ", ".join([drop[2], *[f(s, r) for s in ("s0", "s1", "s3") for f, r in ((keep, "u"), (rerole, "user"))]])
    return f"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        h AS (
            SELECT *, xor(4294967295, list_reduce(
                list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT),
                lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)),
                4294967295)) % 20 AS h FROM k),
        d AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM h, (VALUES (1), (2)) v(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
        f AS (
            SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS open,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
        g AS (SELECT *, blank OR again AS bad, (NOT blank AND NOT again AND open)::BIGINT AS cut FROM f),
        walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', t := '') AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
                   struct_pack(c := 2::BIGINT, a := 'I', t := {user}) AS s2, struct_pack(c := 4::BIGINT, a := 'II', t := {both}) AS s3 FROM conversations
            UNION ALL
            SELECT conv_id, i, n0, n1, least(n2, {edit("n0", "2", "I", user)}, {edit("n1", "2", "I", user)}, {edit("n3", "2", "I", user)}),
                   least(n3, {edit("n2", "2", "I", "chr(10) || 'assistant:'")}, {edit("n0", "4", "II", both)}, {edit("n1", "4", "II", both)})
            FROM (
                SELECT g.conv_id, g.i, {drop[0]} AS n0, least({drop[1]}, {keep("s0", "s")}) AS n1, least({n2}) AS n2,
                       least({drop[3]}, {keep("s2", "a")}, {rerole("s2", "assistant")}) AS n3
                FROM walk JOIN g ON g.conv_id IS NOT DISTINCT FROM walk.conv_id AND g.i = walk.i + 1)),
        best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS s, max(i) AS n FROM walk GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY conv_id)
        SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CASE WHEN n = 0 THEN 0 ELSE s.c END AS cost, CASE WHEN n = 0 THEN '' ELSE s.a END AS audit,
               sha256(CASE WHEN n = 0 THEN '' ELSE substr(s.t, 2) END) AS repaired_sha256
        FROM best LEFT JOIN counts ON best.conv_id IS NOT DISTINCT FROM counts.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_AZ} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
        g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS keep FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS intact
        FROM g""",
    "op11_filter_audit": r"""
        WITH RECURSIVE orders AS (
            SELECT '' AS filter_order, 0 AS n
            UNION ALL
            SELECT filter_order || f, n + 1 FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE n < 5 AND NOT contains(filter_order, f)),
        steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
            FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step) WHERE n = 5),
        d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        m AS (
            SELECT part, concat(
                CASE WHEN len(w) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS mask,
                coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        r AS (
            SELECT part, filter_order, step, f, n, good, toxic, contains(mask, f) AS fails, mask = f AS alone,
                   translate(mask, before, '') = mask AS met
            FROM c, steps),
        a AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (met AND NOT fails), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (met AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND NOT met), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (met AND fails), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (met AND fails), 0)::BIGINT AS toxic_lost
            FROM r GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM a""",
    "op13_turn_repair": _repair_sql(),
}
