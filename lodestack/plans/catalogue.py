"""Registered queries over the driver's tables, and the same in SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import rules as R
from lodestack.operators import audit, evaluation, ledger, search, store

KEY = b"ledger-key"
OVERRIDES = {"PERM-004": "INFO"}
PAIR = (r"(?i)licen[cs]e", r"(?i)released|version")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_sql(rules) -> str:
    return "(VALUES " + ", ".join(f"({_q(r.code)}, {_q(r.severity)}, {_q(r.name)}, {_q(r.pattern)})" for r in rules) + ") r(code, severity, title, pattern)"


def _findings_sql(rules) -> str:
    return f"""lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_number, unnest(ls) AS line
                        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        f AS (SELECT doc_id, line_number, code, severity, title FROM lines, {_rules_sql(rules)}
              WHERE regexp_matches(line, pattern) AND NOT (code = 'SEC-001' AND regexp_matches(line, {_q(audit.any_of(R.ALLOWED))}))
                    AND NOT (title = 'yaml.load without SafeLoader' AND regexp_matches(line, 'yaml\\.safe_load\\s*\\(|Loader\\s*=\\s*(?:yaml\\.)?SafeLoader')))"""


ALL_RULES = R.SECRETS + R.PRIVILEGES
_SCORED = f"""WITH {_findings_sql(ALL_RULES)},
        n AS (SELECT doc_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning,
                     count(*) FILTER (severity = 'INFO') AS info FROM f GROUP BY doc_id),
        s AS (SELECT doc_id, source, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info,
                     greatest(0, 100 - 25 * coalesce(critical, 0) - 10 * coalesce(warning, 0) - 2 * coalesce(info, 0)) AS score
              FROM documents LEFT JOIN n USING (doc_id)),
        g AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s)"""


@query(f"WITH {_findings_sql(R.SECRETS)} SELECT * FROM f")
def secret_findings(spark, sf_dir):
    return audit.findings(_t(spark, sf_dir, "documents"), R.SECRETS)


@query(f"WITH {_findings_sql(R.CODE)} SELECT * FROM f")
def code_findings(spark, sf_dir):
    return audit.findings(_t(spark, sf_dir, "documents"), R.CODE)


@query(f"WITH {_findings_sql(R.PRIVILEGES)} SELECT * FROM f")
def privileged_instruction_findings(spark, sf_dir):
    return audit.findings(_t(spark, sf_dir, "documents"), R.PRIVILEGES)


@query(f"{_SCORED} SELECT doc_id, critical, warning, info, score, grade, critical = 0 AS passed FROM g")
def doc_audit_grade(spark, sf_dir):
    return audit.audit(_t(spark, sf_dir, "documents").select("doc_id", "text"), ALL_RULES)


@query(f"{_SCORED} SELECT source, grade, count(*) AS documents, sum(critical)::BIGINT AS critical FROM g GROUP BY source, grade")
def grade_distribution(spark, sf_dir):
    scored = audit.audit(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), ALL_RULES)
    return scored.groupBy("source", "grade").agg(F.count(F.lit(1)).alias("documents"), F.sum("critical").alias("critical"))


@query(f"""WITH {_findings_sql(ALL_RULES)} SELECT CASE WHEN code = 'PERM-004' THEN 'INFO' ELSE severity END AS severity, code, count(*) AS findings
           FROM f WHERE code <> 'SEC-005' GROUP BY 1, 2""")
def severity_override(spark, sf_dir):
    found = audit.configure(audit.findings(_t(spark, sf_dir, "documents"), ALL_RULES), ["SEC-005"], OVERRIDES)
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"))


_EXEMPT_SQL = " AND ".join(f"NOT (code = {_q(c)} AND regexp_matches(line, {_q(audit.any_of(ps))}))" for c, ps in R.EXEMPT.items())
_EVERYWHERE = f"""WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_number, unnest(ls) AS line
                                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        b AS (SELECT *, regexp_matches(line, {_q(R.FENCE)}) AS fence, sum(regexp_matches(line, {_q(R.FENCE)})::INT) OVER (PARTITION BY doc_id ORDER BY line_number) AS fences FROM lines),
        f AS (SELECT doc_id, line_number, code, severity, title FROM lines, {_rules_sql(R.EVERYWHERE)} WHERE regexp_matches(line, pattern) AND {_EXEMPT_SQL}
              UNION ALL SELECT doc_id, line_number, code, severity, title FROM b, {_rules_sql((R.FENCED,))} WHERE NOT fence AND fences % 2 = 1 AND regexp_matches(line, pattern))"""


@query(f"{_EVERYWHERE} SELECT * FROM f")
def document_findings(spark, sf_dir):
    """All line rules that hold for files of any kind."""
    docs = _t(spark, sf_dir, "documents")
    return audit.findings(docs, R.EVERYWHERE).unionByName(audit.fenced_findings(docs))


@query(f"""{_EVERYWHERE}, n AS (SELECT doc_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning,
                     count(*) FILTER (severity = 'INFO') AS info FROM f GROUP BY doc_id),
        s AS (SELECT doc_id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info,
                     greatest(0, 100 - 25 * coalesce(critical, 0) - 10 * coalesce(warning, 0) - 2 * coalesce(info, 0)) AS score FROM documents LEFT JOIN n USING (doc_id))
        SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, critical = 0 AS passed FROM s""")
def document_grade(spark, sf_dir):
    """doc_audit_grade with all line rules that hold for files of any kind."""
    return audit.audit(_t(spark, sf_dir, "documents").select("doc_id", "text"), R.EVERYWHERE, fences=True)


@query(f"""SELECT doc_id, trim(string_split(found[1], chr(10))[1]) AS heading FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '(?m)^#+\\s+')[2:],
                     lambda x: regexp_matches(x, {_q(R.DATED)}) AND NOT regexp_matches(string_split(x, chr(10))[1], {_q(R.OLD)})) AS found FROM documents) WHERE len(found) > 0""")
def dated_sections(spark, sf_dir):
    heading = audit.dated_section(F.col("text"), R.DATED, R.OLD)
    return _t(spark, sf_dir, "documents").select("doc_id", heading.alias("heading")).where("heading IS NOT NULL")


@query(f"SELECT doc_id, n AS words FROM (SELECT doc_id, len(regexp_extract_all(text, {_q(R.WORKFLOW)})) AS n FROM documents) WHERE n >= 3")
def workflow_verb_flags(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(R.WORKFLOW)).cast("long").alias("words"))
    return docs.where("words >= 3")


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) // 4 AS n_tokens, length(text) // 4 > 5000 AS over_tokens,
                 len(string_split(text, chr(10))) > 500 AS over_lines,
                 floor(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) * 1.3) > 4000 AS over_words FROM documents""")
def token_budget_flags(spark, sf_dir):
    text = F.col("text")
    n_lines, n_tokens = F.size(audit.lines(text)).cast("long"), F.floor(F.length(text) / 4).cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", n_lines.alias("n_lines"), n_tokens.alias("n_tokens"), (n_tokens > 5000).alias("over_tokens"), (n_lines > 500).alias("over_lines"),
        (F.floor(words * 1.3) > 4000).alias("over_words"),
    )


@query("""SELECT doc_id, length(d) > 1024 AS too_long, length(d) < 20 AS too_short, length(trim(d)) < 60 AS vague,
                 NOT regexp_matches(d, '(?i)^\\s*Use when\\b') AS no_trigger FROM (SELECT doc_id, string_split(text, chr(10))[1] AS d FROM documents)""")
def description_length_flags(spark, sf_dir):
    d = F.substring_index("text", "\n", 1)
    return _t(spark, sf_dir, "documents").select(
        "doc_id", (F.length(d) > 1024).alias("too_long"), (F.length(d) < 20).alias("too_short"), (F.length(F.trim(d)) < 60).alias("vague"),
        (~d.rlike(r"(?i)^\s*Use when\b")).alias("no_trigger"),
    )


_GROUP_SQL = [" + ".join(f"regexp_matches(t, '\\b{w}\\b')::INT" for w in g) for g in R.SYNONYMS]


@query(f"""SELECT doc_id, CASE WHEN {_GROUP_SQL[0]} >= 3 THEN 0 WHEN {_GROUP_SQL[1]} >= 3 THEN 1 WHEN {_GROUP_SQL[2]} >= 3 THEN 2 END::BIGINT AS word_group
           FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE {" OR ".join(f"{g} >= 3" for g in _GROUP_SQL)}""")
def synonym_mix(spark, sf_dir):
    low = F.lower("text")
    held = [sum((low.rlike(rf"\b{w}\b").cast("int") for w in g), F.lit(0)) for g in R.SYNONYMS]
    first = F.coalesce(*[F.when(h >= 3, i) for i, h in enumerate(held)]).cast("long")
    return _t(spark, sf_dir, "documents").select("doc_id", first.alias("word_group")).where("word_group IS NOT NULL")


@query(f"SELECT doc_id, regexp_extract(text, {_q(R.DATED)}) AS phrase FROM documents WHERE regexp_matches(text, {_q(R.DATED)})")
def dated_language(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(F.col("text").rlike(R.DATED)).select("doc_id", F.regexp_extract("text", R.DATED, 0).alias("phrase"))


_SAFE_SQL = " AND ".join(f"domain <> {_q(s)} AND NOT ends_with(domain, {_q('.' + s)})" for s in R.SAFE_DOMAINS)


@query(f"""SELECT url, domain FROM (SELECT url, lower(regexp_extract(url, '^(?i)https?://([^/:]+)', 1)) AS domain FROM
           (SELECT DISTINCT regexp_replace(u, '[.,;:)\\]}}''"]+$', '') AS url FROM
            (SELECT unnest(regexp_extract_all(url, '(?i)https?://[^\\s''")>\\]]+')) AS u FROM pages))) WHERE domain <> '' AND {_SAFE_SQL}""")
def url_inventory(spark, sf_dir):
    return audit.url_inventory(_t(spark, sf_dir, "pages"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_number, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
           SELECT doc_id, line_number FROM (SELECT doc_id, line_number, line, max(regexp_matches(line, {_q(PAIR[1])})) OVER
             (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM l) WHERE regexp_matches(line, {_q(PAIR[0])}) AND near""")
def context_window_flags(spark, sf_dir):
    return audit.window_flags(_t(spark, sf_dir, "documents"), *PAIR)


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_id, count(*) AS refs FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return store.first_in(_t(spark, sf_dir, "documents"))


@query("""SELECT source, count(*) AS files, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(coalesce(text, '')), '' ORDER BY doc_id::VARCHAR)) AS fingerprint
          FROM documents GROUP BY source""")
def source_fingerprint(spark, sf_dir):
    return store.fingerprint(_t(spark, sf_dir, "documents"), "source", F.col("doc_id").cast("string"), store.sha256(F.col("text")))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
          b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 1)
          SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'modified' END AS change
          FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def change_set(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return store.change_set(old, docs.where("doc_id % 3 <> 1").select("doc_id", F.sha2(altered, 256).alias("h")), "doc_id", "h")


@query(f"""WITH {_findings_sql(ALL_RULES)},
          k AS (SELECT code, title, doc_id, CASE WHEN doc_id % 5 <> 0 THEN line_number END AS line_number FROM f),
          a AS (SELECT DISTINCT * FROM k WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT * FROM k WHERE doc_id % 3 <> 1)
          SELECT *, 'new' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def regression_diff(spark, sf_dir):
    found = audit.findings(_t(spark, sf_dir, "documents"), ALL_RULES)
    found = found.withColumn("line_number", F.when(F.col("doc_id") % 5 != 0, F.col("line_number")))
    return store.compare_findings(found.where("doc_id % 3 <> 0"), found.where("doc_id % 3 <> 1"), ["code", "title", "doc_id", "line_number"])


@query("""SELECT doc_id, 'dangling' AS problem FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE source <> 'src3')
          UNION ALL SELECT doc_id, 'orphan' FROM (SELECT doc_id FROM documents WHERE source <> 'src3' EXCEPT SELECT doc_id FROM labels)""")
def store_consistency(spark, sf_dir):
    return store.consistency(_t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").where("source <> 'src3'"), "doc_id")


_TERMS = ("license", "version")


@query("""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents),
          c AS (SELECT doc_id, len([x FOR x IN w IF x <> '']) AS n, len([x FOR x IN w IF x = 'license']) AS f0, len([x FOR x IN w IF x = 'version']) AS f1 FROM w),
          s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
          SELECT doc_id, round(greatest(1e-6, ln((docs - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean))
                             + greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 10) AS rank
          FROM c, s WHERE f0 > 0 AND f1 > 0 ORDER BY rank DESC, doc_id LIMIT 20""")
def catalog_search(spark, sf_dir):
    return search.bm25(_t(spark, sf_dir, "documents"), _TERMS, 20)


@query("SELECT lang, count(*) AS total FROM documents WHERE starts_with(source, 'src1') AND contains(lower(text), 'licens') GROUP BY lang")
def catalog_count(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where(F.col("source").startswith("src1") & F.lower("text").contains("licens"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark, sf_dir):
    return store.latest(_t(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


_VERSION_SQL = "(l_suppkey % 3)::VARCHAR || '.' || (l_partkey % 12)::VARCHAR || '.' || l_linenumber::VARCHAR"


def _version():
    return F.concat_ws(".", (F.col("l_suppkey") % 3).cast("string"), (F.col("l_partkey") % 12).cast("string"), F.col("l_linenumber").cast("string"))


@query(f"""SELECT l_orderkey, max(v) AS last_as_text, arg_max(v, string_split(v, '.')::INT[]) AS last_version, count(DISTINCT v) AS versions
           FROM (SELECT l_orderkey, {_VERSION_SQL} AS v FROM lineitem) GROUP BY l_orderkey""")
def version_listing(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").select("l_orderkey", _version().alias("v")).distinct()
    return v.groupBy("l_orderkey").agg(F.max("v").alias("last_as_text"), F.max_by("v", store.semver_key(F.col("v"))).alias("last_version"), F.count(F.lit(1)).alias("versions"))


@query(f"""WITH v AS (SELECT DISTINCT {_VERSION_SQL} AS version, CASE l_linenumber % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'patch' END AS level FROM lineitem),
           p AS (SELECT *, string_split(version, '.')::INT[] AS k FROM v)
           SELECT version, level, CASE level WHEN 'major' THEN (k[1] + 1) || '.0.0' WHEN 'minor' THEN k[1] || '.' || (k[2] + 1) || '.0' ELSE k[1] || '.' || k[2] || '.' || (k[3] + 1) END AS next FROM p""")
def semver_bump(spark, sf_dir):
    level = F.when(F.col("l_linenumber") % 3 == 0, "major").when(F.col("l_linenumber") % 3 == 1, "minor").otherwise("patch")
    v = _t(spark, sf_dir, "lineitem").select(_version().alias("version"), level.alias("level")).distinct()
    return v.withColumn("next", store.bump(F.col("version"), F.col("level")))


@query("""SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events
          WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '2024-01-05T00:00:00' AND '2024-01-20T23:59:59'""")
def ledger_range(spark, sf_dir):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return _t(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", at.alias("at")).where("at BETWEEN '2024-01-05T00:00:00' AND '2024-01-20T23:59:59'")


_INNER, _OUTER = (x.hex() for x in ledger.pads(KEY))
_PAYLOAD_SQL = "event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || {kind} || '|' || coalesce(props, '')"
_HMAC = "sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({m}))))"
_sign = lambda m: _HMAC.format(o=_OUTER, i=_INNER, m=m)
_TRUE, _SEEN = _PAYLOAD_SQL.format(kind="event_type"), _PAYLOAD_SQL.format(kind="kind")


@query(f"""WITH s AS (SELECT *, {_sign(_TRUE)} AS signature FROM events),
           p AS (SELECT *, lag(signature) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_signature,
                        CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE event_type END AS kind FROM s),
           k AS (SELECT * FROM p WHERE event_id % 89 <> 0),
           c AS (SELECT user_id, signature = {_sign(_SEEN)} AS good_signature,
                        coalesce(prev_signature, '') = coalesce(lag(signature) OVER (PARTITION BY user_id ORDER BY event_id), '') AS good_link FROM k)
           SELECT user_id, count(*) FILTER (good_signature AND good_link) AS valid, count(*) FILTER (NOT good_signature) AS forged, count(*) FILTER (NOT good_link) AS broken
           FROM c GROUP BY user_id""")
def ledger_chain_verify(spark, sf_dir):
    """Chains by user; each 97th entry is altered and each 89th deleted after signing."""
    payload = lambda kind: F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind, F.coalesce("props", F.lit("")))
    log = _t(spark, sf_dir, "events").withColumn("signature", ledger.hmac_sha256(payload(F.col("event_type")), KEY))
    log = log.withColumn("prev_signature", F.lag("signature").over(Window.partitionBy("user_id").orderBy("event_id")))
    log = log.withColumn("kind", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("event_type"))).where("event_id % 89 <> 0")
    checked = ledger.verify(log, "user_id", "event_id", payload(F.col("kind")), KEY)
    return checked.groupBy("user_id").agg(
        F.count_if(F.col("good_signature") & F.col("good_link")).alias("valid"), F.count_if(~F.col("good_signature")).alias("forged"), F.count_if(~F.col("good_link")).alias("broken")
    )


@query(f"""WITH s AS (SELECT *, {_sign(_TRUE)} AS signature FROM events),
           p AS (SELECT *, lag(signature) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_signature,
                        CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE event_type END AS kind FROM s),
           k AS (SELECT user_id, event_id, event_id % 83 <> 0 AS readable, signature = {_sign(_SEEN)} AS good, coalesce(prev_signature, '') AS prev, signature AS sig FROM p WHERE event_id % 89 <> 0),
           l AS (SELECT user_id, coalesce(list({{'good': good, 'prev': prev, 'sig': sig, 'n': 0}} ORDER BY event_id) FILTER (readable), []) AS es,
                        count(*) FILTER (NOT readable) AS parse_errors FROM k GROUP BY user_id),
           r AS (SELECT user_id, len(es) AS entries, parse_errors, list_reduce(list_prepend({{'good': true, 'prev': '', 'sig': '', 'n': 0}}, es),
                        lambda a, e: CASE WHEN e.good AND e.prev = a.sig THEN {{'good': true, 'prev': '', 'sig': e.sig, 'n': a.n + 1}} ELSE a END).n::BIGINT AS valid FROM l)
           SELECT user_id, valid, entries - valid AS invalid, parse_errors FROM r""")
def ledger_integrity(spark, sf_dir):
    """ledger_chain_verify's chains, with each 83rd entry unreadable; an entry links to the last valid one, not to the one before."""
    payload = lambda kind: F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind, F.coalesce("props", F.lit("")))
    log = _t(spark, sf_dir, "events").withColumn("signature", ledger.hmac_sha256(payload(F.col("event_type")), KEY))
    log = log.withColumn("prev_signature", F.lag("signature").over(Window.partitionBy("user_id").orderBy("event_id")))
    log = log.withColumn("kind", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("event_type"))).where("event_id % 89 <> 0")
    return ledger.integrity(log, "user_id", "event_id", payload(F.col("kind")), KEY, F.col("event_id") % 83 != 0)


_SAYINGS = (
    ("contains 'THE'", "contains(t, 'the')"), ("does not contain password", "NOT contains(t, 'password')"), ("Is valid JSON", "json_valid(text)"), ("has at least 2 lines", "contains(trim(text, chr(10)), chr(10))"),
    ('starts with "A"', "starts_with(ltrim(t), 'a')"), ("ends with .", "ends_with(rtrim(t), '.')"), ("matches regex /[0-9]{3}/", "regexp_matches(text, '[0-9]{3}')"),
    ("contains zzz or ends with ! or starts with t", "contains(t, 'zzz') OR ends_with(rtrim(t), '!') OR starts_with(ltrim(t), 't')"), ("is it good", "NULL::BOOLEAN"), ("contains x or is it good", "contains(t, 'x or is it good')"),
)


@query(f"""WITH c AS (SELECT *, lower(text) AS t FROM conversations) {' UNION ALL '.join(f"SELECT conv_id, turn, {_q(a)} AS assertion, {b} AS passed FROM c" for a, b in _SAYINGS)}""")
def stated_assertions(spark, sf_dir):
    """Assertions in words; null stands for one that only a judge can decide."""
    said = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.array(*[F.lit(a) for a, _ in _SAYINGS])).alias("assertion"))
    return said.select("conv_id", "turn", "assertion", evaluation.stated(F.col("text"), F.col("assertion")).alias("passed"))


_CHECKS = (("contains", "the"), ("absent", "password"), ("starts", "a"), ("ends", "."), ("lines", "2"))
_GRADES_SQL = """g AS (SELECT conv_id, turn, kind, value, CASE kind WHEN 'contains' THEN contains(t, value) WHEN 'absent' THEN NOT contains(t, value)
          WHEN 'starts' THEN starts_with(t, value) WHEN 'ends' THEN ends_with(t, value) ELSE len(string_split(t, chr(10))) >= 2 END AS passed
          FROM (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'assistant'),
          (VALUES ('contains', 'the'), ('absent', 'password'), ('starts', 'a'), ('ends', '.'), ('lines', '2')) a(kind, value))"""


def _grades(spark, sf_dir):
    said = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    checks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in _CHECKS])
    out = said.select("conv_id", "turn", "text", F.explode(checks).alias("c")).select("conv_id", "turn", "text", "c.kind", "c.value")
    return out.select("conv_id", "turn", "kind", "value", evaluation.assertion(F.col("kind"), F.col("text"), F.col("value")).alias("passed"))


@query(f"WITH {_GRADES_SQL} SELECT * FROM g")
def assertion_grades(spark, sf_dir):
    return _grades(spark, sf_dir)


@query(f"""WITH {_GRADES_SQL} SELECT conv_id, coalesce(round(avg(passed::INT), 6), 1.0) AS pass_rate, count(passed) AS assertions
           FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id) GROUP BY conv_id""")
def case_pass_rate(spark, sf_dir):
    """A case without assertions passes."""
    cases = _t(spark, sf_dir, "conversations").select("conv_id").distinct()
    by = _grades(spark, sf_dir).groupBy("conv_id").agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.count("passed").alias("assertions"))
    return cases.join(by, "conv_id", "left").select("conv_id", F.coalesce("pass_rate", F.lit(1.0)).alias("pass_rate"), F.coalesce("assertions", F.lit(0)).alias("assertions"))


_ARMS_SQL = """SELECT user_id % 50 AS eval_id, count(*) FILTER (event_type = 'purchase') AS n_with, count(*) FILTER (event_type = 'view') AS n_without,
          coalesce(avg((value > 50)::INT) FILTER (event_type = 'purchase'), 0.0) AS p_with, coalesce(avg((value > 50)::INT) FILTER (event_type = 'view'), 0.0) AS p_without,
          coalesce(avg(value) FILTER (event_type = 'purchase'), 0.0) AS t_with, coalesce(avg(value) FILTER (event_type = 'view'), 0.0) AS t_without,
          coalesce(stddev_samp(value) FILTER (event_type = 'purchase'), 0.0) AS s_with FROM events GROUP BY 1"""


def _arms(spark, sf_dir):
    arm = lambda kind, x: F.when(F.col("event_type") == kind, x)
    good = (F.col("value") > 50).cast("int")
    m = evaluation.mean
    return _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("eval_id")).agg(
        F.count(arm("purchase", F.lit(1))).alias("n_with"), F.count(arm("view", F.lit(1))).alias("n_without"),
        m(arm("purchase", good)).alias("p_with"), m(arm("view", good)).alias("p_without"),
        m(arm("purchase", F.col("value"))).alias("t_with"), m(arm("view", F.col("value"))).alias("t_without"),
        evaluation.spread(arm("purchase", F.col("value"))).alias("s_with"),
    )


@query(f"""WITH a AS ({_ARMS_SQL}),
          b AS (SELECT *, p_with / CASE WHEN t_with = 0 THEN 1 ELSE t_with END AS o, CASE WHEN p_without > 0 THEN p_without / CASE WHEN t_without = 0 THEN 1 ELSE t_without END ELSE 0 END AS w,
                (t_with - t_without) / nullif(t_without, 0) * 100 AS c FROM a)
          SELECT eval_id, round(p_with, 6) AS pass_rate, round(p_with - p_without, 6) AS delta, round(s_with, 6) AS deviation, p_with >= p_without AND p_with >= 0.5 AS passed,
            round(CASE WHEN w = 0 THEN CASE WHEN o > 0 THEN 1.0 ELSE 0.5 END ELSE least(1.0, 2 * (o / w) / (1 + o / w)) END, 6) AS efficiency,
            CASE WHEN p_with - p_without <= -0.05 THEN 'REJECT' WHEN p_with - p_without >= 0 AND c <= 0 THEN 'PARETO_BETTER' WHEN p_with - p_without > 0 AND c > 0 THEN 'TRADEOFF'
                 WHEN p_with - p_without <= 0 AND c < 0 THEN 'CHEAPER_BUT_WEAKER' ELSE 'PARETO_WORSE' END AS trade FROM b""")
def arm_benchmark(spark, sf_dir):
    a = _arms(spark, sf_dir)
    delta = F.col("p_with") - F.col("p_without")
    cost = (F.col("t_with") - F.col("t_without")) / F.nullif(F.col("t_without"), F.lit(0.0)) * 100
    return a.select(
        "eval_id", F.round("p_with", 6).alias("pass_rate"), F.round(delta, 6).alias("delta"), F.round("s_with", 6).alias("deviation"),
        ((delta >= 0) & (F.col("p_with") >= 0.5)).alias("passed"),
        F.round(evaluation.efficiency(F.col("p_with"), F.col("t_with"), F.col("p_without"), F.col("t_without")), 6).alias("efficiency"),
        evaluation.trade_off(delta, cost).alias("trade"),
    )


@query(f"""WITH a AS ({_ARMS_SQL}), b AS (SELECT eval_id, CASE WHEN p_with > 0 THEN t_with / p_with END AS x, CASE WHEN p_without > 0 THEN t_without / p_without END AS y FROM a)
          SELECT eval_id, round(x, 4) AS tokens_a, round(y, 4) AS tokens_b, CASE WHEN x IS NULL AND y IS NULL THEN 'tie' WHEN x IS NULL THEN 'b' WHEN y IS NULL THEN 'a'
            WHEN y = 0 OR x / y > 1.05 THEN 'b' WHEN x / y < 1 / 1.05 THEN 'a' ELSE 'tie' END AS winner FROM b""")
def side_by_side_winner(spark, sf_dir):
    a = _arms(spark, sf_dir)
    x, y = F.when(F.col("p_with") > 0, F.col("t_with") / F.col("p_with")), F.when(F.col("p_without") > 0, F.col("t_without") / F.col("p_without"))
    return a.select("eval_id", F.round(x, 4).alias("tokens_a"), F.round(y, 4).alias("tokens_b"), evaluation.winner(x, y, "a", "b").alias("winner"))


@query("""WITH t AS (SELECT source, toxic = 1 AS want, n_chars % 4 = 0 OR contains(lower(text), 'idiot') AS fired FROM labels JOIN documents USING (doc_id))
          SELECT source, coalesce(round(avg(fired::INT) FILTER (want), 6), 1.0) AS recall_positive, coalesce(round(avg((NOT fired)::INT) FILTER (NOT want), 6), 1.0) AS recall_negative,
            count(*) FILTER (fired = want) AS right_answers, count(*) AS queries FROM t GROUP BY source""")
def trigger_report(spark, sf_dir):
    t = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    t = t.select("source", (F.col("toxic") == 1).alias("want"), ((F.col("n_chars") % 4 == 0) | F.lower("text").contains("idiot")).alias("fired"))
    recall = lambda kind, hit: F.coalesce(F.round(F.avg(F.when(kind, hit.cast("int"))), 6), F.lit(1.0))
    return t.groupBy("source").agg(
        recall(F.col("want"), F.col("fired")).alias("recall_positive"), recall(~F.col("want"), ~F.col("fired")).alias("recall_negative"),
        F.count_if(F.col("fired") == F.col("want")).alias("right_answers"), F.count(F.lit(1)).alias("queries"),
    )


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'tool' WHEN bool_or(contains(lower(text), 'the')) THEN 'text' ELSE 'none' END AS signal
          FROM conversations GROUP BY conv_id""")
def trigger_signal(spark, sf_dir):
    by = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("a"), F.bool_or(F.lower("text").contains("the")).alias("b"))
    return by.select("conv_id", F.when(F.col("a"), "tool").when(F.col("b"), "text").otherwise("none").alias("signal"))


@query("""SELECT doc_id, round(CASE WHEN q IS NULL AND t IS NULL AND c IS NULL THEN 0.0 ELSE (coalesce(q * 0.4, 0) + coalesce(t * 0.4, 0) + coalesce(c * 0.2, 0)) /
            (CASE WHEN q IS NULL THEN 0 ELSE 0.4 END + CASE WHEN t IS NULL THEN 0 ELSE 0.4 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END) END, 6) AS score FROM
          (SELECT doc_id, quality AS q, 1 - toxic AS t, CASE WHEN n_chars > 500 THEN least(1.0, n_chars / 5000.0) END AS c FROM documents LEFT JOIN labels USING (doc_id))""")
def weighted_score(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    length = F.when(F.col("n_chars") > 500, F.least(F.lit(1.0), F.col("n_chars") / 5000.0))
    return rows.select("doc_id", F.round(evaluation.weighted([(F.col("quality"), 0.4), (1 - F.col("toxic"), 0.4), (length, 0.2)]), 6).alias("score"))


_PRICE_SQL = "(VALUES " + ", ".join(f"({_q(n)}, {a}::DECIMAL(9, 2), {b}::DECIMAL(9, 2))" for n, a, b in R.PRICES) + ") p(model, pi, po)"


@query(f"""WITH c AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'Opus' WHEN 1 THEN 'haiku' WHEN 2 THEN 'gpt-4o' ELSE 'other' END AS model,
            sum(length(text)) FILTER (role <> 'assistant') AS i, sum(length(text)) FILTER (role = 'assistant') AS o FROM conversations GROUP BY conv_id),
          d AS (SELECT conv_id, c.model, coalesce(i, 0)::BIGINT AS tokens_in, coalesce(o, 0)::BIGINT AS tokens_out, coalesce(pi, 3.0) AS pi, coalesce(po, 15.0) AS po FROM c LEFT JOIN {_PRICE_SQL} ON lower(c.model) = p.model)
          SELECT conv_id, model, tokens_in, tokens_out, round(tokens_in * pi, 0)::DOUBLE / 1e6 AS input_cost, round(tokens_out * po, 0)::DOUBLE / 1e6 AS output_cost,
            round(tokens_in * pi + tokens_out * po, 0)::DOUBLE / 1e6 AS total_cost FROM d""")
def cost_estimate(spark, sf_dir):
    n = F.length("text").cast("long")
    mine = F.col("role") == "assistant"
    by = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(~mine, n)), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(mine, n)), F.lit(0)).alias("tokens_out"))
    model = F.element_at(F.array(*map(F.lit, ("Opus", "haiku", "gpt-4o", "other"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return evaluation.with_cost(by.withColumn("model", model), "model", "tokens_in", "tokens_out")


@query("""SELECT user_id, min(event_id) FILTER (total > 500) AS first_over, round(max(total), 4) AS spent FROM
          (SELECT user_id, event_id, sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) GROUP BY user_id""")
def budget_cutoff(spark, sf_dir):
    r = store.running(_t(spark, sf_dir, "events"), "user_id", ["event_id"], F.coalesce("value", F.lit(0.0)), "total")
    return r.groupBy("user_id").agg(F.min(F.when(F.col("total") > 500, F.col("event_id"))).alias("first_over"), F.round(F.max("total"), 4).alias("spent"))


@query("""WITH b AS (SELECT user_id, event_id, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS up FROM events),
          g AS (SELECT user_id, event_id, up, sum(up::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM b),
          r AS (SELECT user_id, grp, count(*) FILTER (NOT up) AS flat FROM g GROUP BY user_id, grp)
          SELECT user_id, max(flat) AS longest_plateau, max(flat) >= 5 AS stopped FROM r GROUP BY user_id""")
def plateau_runs(spark, sf_dir):
    """Longest run of events without a new best value."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = _t(spark, sf_dir, "events").withColumn("up", F.coalesce(F.col("value") > F.coalesce(best, F.lit(-1.0)), F.lit(False)))
    e = e.withColumn("grp", F.sum(F.col("up").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy("user_id", "grp").agg(F.count_if(~F.col("up")).alias("flat"))
    return runs.groupBy("user_id").agg(F.max("flat").alias("longest_plateau"), (F.max("flat") >= 5).alias("stopped"))


@query("""SELECT user_id, CASE WHEN best - 80 >= 5 THEN variant END AS promoted, round(coalesce(best, 80.0), 6) AS best_score FROM
          (SELECT user_id, max(value) AS best, arg_min(event_id, (-value, event_id)) FILTER (value IS NOT NULL) AS variant FROM events GROUP BY user_id)""")
def promotion_gate(spark, sf_dir):
    """The first of the best variants is promoted if it beats a current score of 80 by 5."""
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("variant"))
    return e.select("user_id", F.when(F.col("best") - 80 >= 5, F.col("variant")).alias("promoted"), F.round(F.coalesce("best", F.lit(80.0)), 6).alias("best_score"))


@query("""SELECT c_custkey, n_name, c_nationkey % 5 = 0 OR c_custkey % 11 = 0 OR c_custkey % 7 < 2 AS can_read, c_nationkey % 5 = 0 OR c_custkey % 7 = 0 AS can_write
          FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def permission_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    given = F.array_compact(F.array(
        F.when(F.col("c_nationkey") % 5 == 0, "admin"), F.when(F.col("c_custkey") % 11 == 0, "read:*"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("write:"), "n_name")), F.when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("read:"), "n_name")),
    ))
    return rows.select("c_custkey", "n_name", *[evaluation.permitted(given, a, F.col("n_name")).alias(f"can_{a}") for a in ("read", "write")])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'removed' ELSE 'type changed' END AS change FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0""")
def param_breaking_changes(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    new = part.where("p_partkey % 13 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 17 == 0, F.concat("p_type", F.lit("?"))).otherwise(F.col("p_type")).alias("type"))
    joined = part.join(new, "p_partkey", "left").where("type IS NULL OR type <> p_type")
    return joined.select("p_partkey", F.when(F.col("type").isNull(), "removed").otherwise("type changed").alias("change"))
