"""Queries over skills, manifests, catalogues and recorded runs that stand on columns of the driver's tables, and the same in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.functions import skill_rules as S
from lodestack.operators import audit, catalog, runs, skills, store
from lodestack.plans.catalogue import ALL_RULES, _findings_sql, _q, _t, query


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _pick(n: str, options: list[str], column: str = "doc_id") -> str:
    """CASE by column modulo the number of options, in SQL that Spark and DuckDB read alike."""
    return f"CASE {column} % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + f" END AS {n}"


# A skill for each document: its front matter stands on the id, its body is the text.
_NAMES = ["concat('csv-', lang)", "concat('Csv-', lang)", "''", "'my-claude-helper'", "repeat('a', 70)", "NULL", "'a--b'", "'-edge'", "'data_set'", "'csv-tool'"]
_DESCRIPTIONS = [
    "substring(text, 1, 1500)", "'Use when the user asks for tables, first run it, then format and finally write the output file.'", "'You can use <b>this</b> for tables'",
    "'short'", "NULL", "'   '", "'I help with reports of every kind and of every length that is asked for'",
]
_TOOLS = [
    "'Bash Read'", "'Bash(git:*) Read'", "'Execute Read mcp__a__b'", "NULL", "'bad_tool Read'", "'Bash(**)'",
    "'Read Write Edit Grep Glob List Task Search ReadFile ListDir WebFetch TodoRead TodoWrite WebSearch MultiEdit FileWrite'", "'HttpRequest  lower Terminal'",
]
_BODIES = [
    "text", "concat(text, ' see docs', chr(92), 'guide.md')", "concat('# Example', chr(10), text)", "concat('call `mcp__server` now ', text)", "concat('```', chr(10), 'your-skill-name', chr(10), '``` ', text)",
    "concat('Insert instructions below: ', text)", "' '", "concat('`mcp__a__b` ', text)",
]
_META = ["NULL", "'{\"a\": 1}'", "'[1, 2]'", "'oops'", "'{\"a\": '"]
_SKILLS = f"""SELECT doc_id, {_pick('name', _NAMES)}, {_pick('folder', ["'csv-en'", "'data_set'", "'a--b'"])}, {_pick('description', _DESCRIPTIONS)},
    {_pick('compatibility', ["NULL", "'any'", "repeat('x', 501)"])}, {_pick('metadata', _META)}, {_pick('tools', _TOOLS)}, {_pick('body', _BODIES)} FROM documents"""


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Rows of a statement that Spark and DuckDB read alike, over tables of the folder."""
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)


def _unnest(source: str, checks: list[tuple[str, str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN '{code} {severity}' END" for code, severity, c in checks)
    return f"""SELECT doc_id, string_split(f, ' ')[1] AS code, string_split(f, ' ')[2] AS severity FROM
        (SELECT doc_id, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS f FROM {source})"""


_HAS, _TOLD = "coalesce(name, '') <> ''", "coalesce(description, '') <> ''"
_STRUCTURE_SQL = [
    ("STR-005", "CRITICAL", "coalesce(name, '') = ''"), ("STR-006", "WARNING", "length(name) > 64"), ("STR-007", "WARNING", f"{_HAS} AND NOT regexp_matches(name, {_q(S.NAME)})"),
    ("STR-008", "INFO", f"{_HAS} AND name <> folder"), ("STR-018", "WARNING", _any("name", S.RESERVED)), ("STR-009", "CRITICAL", "coalesce(description, '') = ''"),
    ("STR-010", "WARNING", "length(description) > 1024"), ("STR-011", "WARNING", f"{_TOLD} AND length(description) < 20"), ("STR-019", "WARNING", f"regexp_matches(description, {_q(S.TAG)})"),
    ("STR-020", "INFO", f"regexp_matches(description, {_q(S.FIRST_PERSON)}) OR regexp_matches(description, {_q(S.SECOND_PERSON)})"), ("STR-012", "WARNING", "length(compatibility) > 500"),
    ("STR-013", "WARNING", "metadata IS NOT NULL AND (NOT json_valid(metadata) OR json_type(CASE WHEN json_valid(metadata) THEN metadata END) <> 'OBJECT')"),
    ("STR-014", "INFO", "len(string_split(body, chr(10))) > 500"), ("STR-015", "INFO", "length(body) // 4 > 5000"), ("STR-021", "INFO", "floor(len(regexp_extract_all(body, '[^\\s]+')) * 1.3) > 4000"),
]
_BARE_SQL = f"len(list_filter(regexp_extract_all(body, {_q(S.BARE_TOOL)}), lambda x: len(string_split(x, '__')) < 3)) > 0"
_ENTRIES_SQL = f"len(list_filter(string_split_regex(trim(tools), '\\s+'), lambda x: x <> '' AND NOT regexp_matches(x, {_q(S.TOOL_ENTRY)}))) > 0"
_PROSE = "lower(regexp_replace(regexp_replace(body, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'))"
_QUALITY_SQL = [
    ("QLT-001", "INFO", "trim(description) <> '' AND NOT regexp_matches(description, '(?i)^\\s*Use when\\b')"), ("QLT-002", "WARNING", "trim(description) <> '' AND length(trim(description)) < 60"),
    ("QLT-003", "WARNING", f"len(regexp_extract_all(description, {_q(S.WORKFLOW)})) >= 3"),
    ("QLT-004", "INFO", f"len(list_intersect(string_split_regex(lower(name), '-+'), [{', '.join(map(_q, S.GENERIC_WORDS))}])) > 0"), ("QLT-005", "INFO", "contains(folder, '_')"),
    ("QLT-007", "WARNING", f"regexp_matches(body, {_q(S.WINDOWS_PATH)})"), ("QLT-013", "INFO", _BARE_SQL), ("QLT-014", "WARNING", _ENTRIES_SQL), ("QLT-016", "WARNING", _any(_PROSE, S.TEMPLATE_MARKERS)),
    ("QLT-017", "INFO", "NOT contains(body, '```') AND NOT regexp_matches(body, '(?im)^#+\\s*(?:example|examples)\\b')"), ("QLT-018", "WARNING", "trim(regexp_replace(body, '\\s+', ' ', 'g')) = ''"),
]
_TOOL_LIST = "string_split_regex(coalesce(tools, ''), '\\s+')"
_HIGH = [t for t, r in S.TOOL_RISKS.items() if r == "high"]
_SHELL_SQL = f"len(list_filter({_TOOL_LIST}, lambda x: x IN {_in(S.SHELLS)})) > 0"
_PERMISSION_SQL = [
    ("PERM-001", "WARNING", _SHELL_SQL), ("PERM-002", "INFO", f"NOT ({_SHELL_SQL}) AND len(list_filter({_TOOL_LIST}, lambda x: x IN {_in(_HIGH)})) > 0"),
    ("PERM-003", "INFO", f"len(list_filter({_TOOL_LIST}, lambda x: x <> '')) > 15"),
]


def _skills(spark, sf_dir):
    return _view(spark, sf_dir, _SKILLS, "documents")


def _structure(s):
    return skills.broken(s, skills.structure_checks(*map(F.col, ("name", "folder", "description", "compatibility", "metadata", "body"))), ["doc_id"])


def _quality(s):
    return skills.broken(s, skills.quality_checks(*map(F.col, ("name", "folder", "description", "tools", "body"))), ["doc_id"])


@query(_unnest(f"({_SKILLS})", _STRUCTURE_SQL))
def skill_structure(spark, sf_dir):
    return _structure(_skills(spark, sf_dir))


@query(_unnest(f"({_SKILLS})", _QUALITY_SQL))
def skill_quality(spark, sf_dir):
    return _quality(_skills(spark, sf_dir))


@query(_unnest(f"({_SKILLS})", _PERMISSION_SQL))
def skill_permissions(spark, sf_dir):
    return skills.broken(_skills(spark, sf_dir), skills.permission_checks(F.col("tools")), ["doc_id"])


_FULL = f"{_unnest(f'({_SKILLS})', _STRUCTURE_SQL)} UNION ALL {_unnest(f'({_SKILLS})', _PERMISSION_SQL)} UNION ALL {_unnest(f'({_SKILLS})', _QUALITY_SQL)}"


def _all_findings(spark, sf_dir):
    s = _skills(spark, sf_dir)
    families = _structure(s), skills.broken(s, skills.permission_checks(F.col("tools")), ["doc_id"]), _quality(s)
    return families[0].unionByName(families[1]).unionByName(families[2])


@query(f"""WITH {_findings_sql(ALL_RULES)}, every AS (SELECT doc_id, code FROM ({_FULL}) UNION ALL SELECT doc_id, code FROM f)
           SELECT doc_id, count(*) FILTER (starts_with(code, 'STR-')) AS str, count(*) FILTER (starts_with(code, 'SEC-')) AS sec, count(*) FILTER (starts_with(code, 'PERM-')) AS perm,
           count(*) FILTER (starts_with(code, 'QLT-')) AS qlt FROM every GROUP BY doc_id""")
def skill_prefix_counts(spark, sf_dir):
    """Findings of all four families by the prefix of their codes."""
    lines = audit.findings(_t(spark, sf_dir, "documents"), ALL_RULES)
    return skills.prefix_counts(_all_findings(spark, sf_dir).select("doc_id", "code").unionByName(lines.select("doc_id", "code")), "doc_id")


_EXPLAIN = {"STR-005": "A name is required.", "QLT-002": "Say more."}, {"STR": "Structure.", "PERM": "Scope."}


@query(f"""WITH f AS ({_FULL}) SELECT code, count(*) AS n, CASE code WHEN 'STR-005' THEN 'A name is required.' WHEN 'QLT-002' THEN 'Say more.' ELSE
           CASE string_split(code, '-')[1] WHEN 'STR' THEN 'Structure.' WHEN 'PERM' THEN 'Scope.' END END AS explanation FROM f GROUP BY code""")
def finding_explanations(spark, sf_dir):
    return skills.explained(_all_findings(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n")), *_EXPLAIN)


_LINES = [
    "'x = 42'", "'MAX_SIZE = 100'", "'n = 77  # because of the header'", "'n = 7'", "'retry = +1234.5 # odd'", "'  port_no = 8080'", "'a == 12'", "'total_count_all = 55'", "'y = 10 #'",
]
_PATHS = ["'doc1.md'", "'src/notes.py'", "'example_a.py'", "'examples/example_b.JS'", "'example-c.go'", "'README.md'", "'tmp12.sh'", "'main.rs'"]
_FILES = f"SELECT p_partkey, p_partkey % 40 AS skill, {_pick('path', _PATHS, 'p_partkey')}, {_pick('line', _LINES, 'p_partkey')} FROM part"


@query(f"""WITH f AS ({_FILES}), n AS (SELECT *, regexp_extract(path, '[^/]+$') AS name, lower(regexp_extract(path, '\\.[A-Za-z]+$')) AS suffix FROM f)
           SELECT skill, count(*) FILTER (regexp_matches(name, {_q(S.GENERIC_FILE)})) AS generic, count(DISTINCT suffix) FILTER (starts_with(name, 'example') AND suffix IN {_in(S.CODE_SUFFIXES)}) AS languages,
             count(DISTINCT suffix) FILTER (starts_with(name, 'example') AND suffix IN {_in(S.CODE_SUFFIXES)}) >= 3 AS many_languages, bool_or(name = 'README.md') AS readme FROM n GROUP BY skill""")
def skill_files(spark, sf_dir):
    """Generic file names, languages of examples, and whether there is a readme."""
    return catalog.file_flags(_view(spark, sf_dir, _FILES, "part"), "skill", F.col("path"))


@query(f"""WITH f AS ({_FILES}), m AS (SELECT *, regexp_extract(line, {_q(S.ASSIGNED_NUMBER)}, 1) AS a, regexp_extract(line, {_q(S.ASSIGNED_NUMBER)}, 2) AS b, lower(regexp_extract(line, {_q(S.ASSIGNED_NUMBER)}, 3)) AS c
             FROM f WHERE regexp_matches(line, {_q(S.ASSIGNED_NUMBER)}))
           SELECT skill, min(p_partkey) AS first_at FROM m WHERE length(b) >= 2 AND NOT regexp_matches(a, {_q(S.EXPLAINING_NAME)}) AND NOT {_any('c', S.EXPLAINING_WORDS)} GROUP BY skill""")
def magic_numbers(spark, sf_dir):
    """The first unexplained number of each skill."""
    f = _view(spark, sf_dir, _FILES, "part")
    return f.where(skills.magic_number(F.col("line"))).groupBy("skill").agg(F.min("p_partkey").alias("first_at"))


_MANIFESTS = f"""SELECT p_partkey, {_pick('api_version', ["'example.io/v1'", "'example.io/v2'", "'example.io/v1'"], 'p_partkey')}, {_pick('kind', ["'Skill'", "'Skill'", "'Tool'", "NULL"], 'p_partkey')},
    {_pick('name', ["'org/tool'", "'tool'", "'Org/Tool'", "''", "NULL"], 'p_partkey')}, {_pick('version', ["'1.0.0'", "'1.0'", "'1.2.3-rc.1+b5'", "'01.0.0'", "'v1.0.0'", "NULL"], 'p_partkey')},
    {_pick('description', ["p_name", "''", "NULL"], 'p_partkey')}, {_pick('category', ["'data'", "'cooking'", "NULL"], 'p_partkey')}, {_pick('content_path', ["'a.md'", "''", "NULL"], 'p_partkey')},
    {_pick('content_inline', ["'x'", "NULL"], 'p_partkey')}, {_pick('param_type', ["'string'", "'enum'", "'date'", "'number'"], 'p_partkey')}, {_pick('capability', ["'exec'", "'fly'"], 'p_partkey')} FROM part"""
_SIMPLE = [
    ("VAL-APIVERSION error apiVersion", "api_version IS DISTINCT FROM 'example.io/v1'"), ("VAL-KIND error kind", "kind IS DISTINCT FROM 'Skill'"),
    ("VAL-NAME-REQUIRED error metadata.name", "coalesce(name, '') = ''"), ("VAL-DESC-REQUIRED error metadata.description", "coalesce(description, '') = ''"),
    ("VAL-SEMVER error metadata.version", f"NOT regexp_matches(coalesce(version, ''), {_q(S.SEMVER)})"), ("VAL-NAME-FORMAT error metadata.name", "name <> '' AND name NOT IN ('org/tool', 'tool')"),
    ("VAL-NAME-NO-NAMESPACE warning metadata.name", "name = 'tool'"), ("VAL-CAT-UNKNOWN warning metadata.category", "category = 'cooking'"),
    ("VAL-CONTENT-BOTH error spec.content", "content_path = 'a.md' AND content_inline = 'x'"), ("VAL-CONTENT-EMPTY error spec.content", "coalesce(content_path, '') = '' AND content_inline IS NULL"),
    ("VAL-PARAM-TYPE error spec.parameters[1].type", "param_type = 'date'"), ("VAL-PARAM-ENUM error spec.parameters[1].values", "param_type = 'enum'"), ("VAL-CAP-UNKNOWN warning spec.capabilities[0]", "capability = 'fly'"),
]


@query(f"""SELECT p_partkey, string_split(f, ' ')[1] AS code, string_split(f, ' ')[2] AS severity, string_split(f, ' ')[3] AS path FROM (SELECT p_partkey, unnest(list_filter(
           [{', '.join(f"CASE WHEN {c} THEN '{x}' END" for x, c in _SIMPLE)}], lambda x: x IS NOT NULL)) AS f FROM ({_MANIFESTS}))""")
def manifest_validation(spark, sf_dir):
    m = _view(spark, sf_dir, _MANIFESTS, "part")
    params = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("type"), v.alias("values")) for n, t, v in (
        ("a", F.lit("enum"), F.array(F.lit("x"))), ("b", F.col("param_type"), F.array().cast("array<string>")))])
    return skills.manifest_issues(m.withColumn("params", params).withColumn("capabilities", F.array("capability")), ["p_partkey"], "example.io/v1")


def _hint_sql(cap: str, declared: str) -> str:
    return f"CASE WHEN NOT ({declared}) AND (" + " OR ".join(f"regexp_matches(body, {_q(p)})" for p in S.CAPABILITY_HINTS[cap]) + f") THEN {_q(cap)} END"


_TALK = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' please fetch and overwrite') WHEN doc_id % 3 = 1 THEN concat('save  file: ', text) ELSE text END AS body FROM documents"


@query(f"""SELECT doc_id, array_to_string(list_filter([{_hint_sql('write_file', 'doc_id % 2 = 0')}, {_hint_sql('network_access', 'doc_id % 5 = 0')}], lambda x: x IS NOT NULL), ',') AS undeclared FROM ({_TALK})""")
def capability_hints(spark, sf_dir):
    declared = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "write_file"), F.when(F.col("doc_id") % 5 == 0, "network_access")))
    return _view(spark, sf_dir, _TALK, "documents").select("doc_id", F.array_join(skills.capability_hints(F.col("body"), declared), ",").alias("undeclared"))


_REFS = f"SELECT p_partkey, {_pick('ref', ['concat(p_brand, chr(64), p_size)', 'concat(chr(64), p_size)', 'p_brand', 'concat(p_brand, chr(64))', 'concat(p_brand, chr(64), p_type, chr(64), p_size)'], 'p_partkey')} FROM part"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(ref, '^(.+)@([^@]+)$') THEN regexp_extract(ref, '^(.+)@([^@]+)$', 1) END AS name,
           CASE WHEN regexp_matches(ref, '^(.+)@([^@]+)$') THEN regexp_extract(ref, '^(.+)@([^@]+)$', 2) END AS version FROM ({_REFS})""")
def parse_refs(spark, sf_dir):
    """name@version references, split at the last @; null where one of them is missing."""
    r = scalars.parse_ref(F.col("ref"))
    return _view(spark, sf_dir, _REFS, "part").select("p_partkey", r["name"].alias("name"), r["version"].alias("version"))


_TEXTS = f"SELECT doc_id, {_pick('t', ['text', 'concat(text, chr(13), chr(10), chr(37), chr(58), chr(44))', 'concat(text, chr(10))', repr('') , 'concat(chr(60), text, chr(38), chr(34), chr(62))', 'concat(chr(12), text, chr(11))'])}, n_chars FROM documents"


@query(f"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(t, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS parameter,
             sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS html,
             (len(regexp_extract_all(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')) + CASE WHEN t = '' OR regexp_matches(t, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]$') THEN 0 ELSE 1 END)::BIGINT AS n_lines,
             repeat('#', round(n_chars % 11 / 10.0 * 10)::INT) AS bar, CASE WHEN (n_chars + 0.3) / 1e6 < 0.01 THEN printf('$%.4f', (n_chars + 0.3) / 1e6) ELSE printf('$%.2f', (n_chars + 0.3) / 1e6) END AS cost,
             CASE doc_id % 3 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/gzip' ELSE 'text/markdown' END AS media FROM ({_TEXTS})""")
def scalar_functions(spark, sf_dir):
    d = _view(spark, sf_dir, _TEXTS, "documents")
    blob = F.when(F.col("doc_id") % 3 == 0, F.lit(b"PK34")).when(F.col("doc_id") % 3 == 1, F.lit(b"\x1f\x8b\x08")).otherwise(F.lit(b"# a"))
    t = F.col("t")
    return d.select(
        "doc_id", F.sha2(scalars.escape_parameter(t), 256).alias("parameter"), F.sha2(scalars.escape_html(t), 256).alias("html"), scalars.line_count(t).alias("n_lines"),
        scalars.bar(F.col("n_chars") % 11 / 10, "#").alias("bar"), scalars.format_cost((F.col("n_chars") + 0.3) / 1e6).alias("cost"), scalars.media_type(blob).alias("media"),
    )


_INDEX = "SELECT l_orderkey % 500 AS name, l_linenumber % 4 AS version, l_partkey AS content, l_orderkey AS seq FROM lineitem"


@query(f"""WITH i AS ({_INDEX}), old AS (SELECT DISTINCT name, version FROM i WHERE seq % 3 = 0 AND name % 7 <> 0),
           new AS (SELECT name, version, min(seq * 100000000 + content) AS k FROM i WHERE seq % 3 <> 0 GROUP BY ALL)
           SELECT name, version, k % 100000000 AS content, CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.name = new.name AND old.version = new.version) THEN 'E_ALREADY_EXISTS' ELSE 'added' END AS status FROM new""")
def push_gate(spark, sf_dir):
    """The first push of each name and version is added unless the index has it."""
    i = _view(spark, sf_dir, _INDEX, "lineitem")
    new = i.where("seq % 3 <> 0").groupBy("name", "version").agg(F.min(F.struct("seq", "content")).alias("m")).select("name", "version", "m.content")
    return catalog.push(i.where("seq % 3 = 0 AND name % 7 <> 0"), new, ["name", "version"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'E_NOT_FOUND' WHEN o_orderkey % 7 = 0 THEN 'E_INTEGRITY' ELSE 'ok' END AS status FROM orders""")
def pull_status(spark, sf_dir):
    """Entries joined to their blobs, whose contents are hashed again."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("content"))
    index = o.select("o_orderkey", F.sha2("content", 256).alias("hash"))
    blobs = o.where("o_orderkey % 5 <> 0").select(F.sha2("content", 256).alias("hash"), F.when(F.col("o_orderkey") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return catalog.pull(index, blobs, "hash", "content").select("o_orderkey", "status")


@query("""WITH t AS (SELECT c_custkey, c_custkey % 4 = 0 AS revoked, c_custkey % 9 < 3 AS asked, c_acctbal AS expires, CASE c_custkey % 5 WHEN 0 THEN ['admin'] WHEN 1 THEN ['read:a', 'write:b', 'write:a']
             WHEN 2 THEN ['read:*'] WHEN 3 THEN ['write:c'] ELSE [] END AS p FROM customer)
           SELECT c_custkey, NOT (revoked OR asked) AND expires > 1000 AS valid, asked AND NOT revoked AS newly_revoked,
             CASE WHEN list_contains(p, 'admin') OR list_contains(p, 'read:*') THEN NULL ELSE array_to_string(list_sort(list_distinct([string_split(x, ':')[2] FOR x IN p])), ',') END AS namespaces FROM t""")
def token_states(spark, sf_dir):
    """Tokens after revocations: valid ones, those that a revocation changed, and the namespaces they may read."""
    c = _t(spark, sf_dir, "customer")
    given = F.element_at(F.array(*[F.array(*map(F.lit, p)).cast("array<string>") for p in (["admin"], ["read:a", "write:b", "write:a"], ["read:*"], ["write:c"], [])]), (F.col("c_custkey") % 5 + 1).cast("int"))
    tokens = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "before").alias("revoked_at"), F.col("c_acctbal").alias("expires"), given.alias("permissions"))
    done = catalog.revoke(tokens, c.where("c_custkey % 9 < 3").select("c_custkey"), "c_custkey", "now")
    spaces = F.array_join(F.array_sort(catalog.allowed_namespaces(F.col("permissions"))), ",")
    return done.select("c_custkey", (F.col("revoked_at").isNull() & (F.col("expires") > 1000)).alias("valid"), F.col("changed").alias("newly_revoked"), spaces.alias("namespaces"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'E_TOO_LARGE' WHEN p_partkey % 11 = 0 THEN 'E_VALIDATION' WHEN p_partkey % 6 = 0 THEN 'E_FORBIDDEN' WHEN p_partkey % 4 = 0 THEN 'E_ALREADY_EXISTS'
           WHEN p_partkey % 10 = 3 THEN 'E_CRITICAL_FINDINGS' END AS reason FROM part""")
def publish_reasons(spark, sf_dir):
    """The first gate that a publication fails."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    gates = [("E_TOO_LARGE", F.col("p_size") > 40), ("E_VALIDATION", k % 11 == 0), ("E_FORBIDDEN", k % 6 == 0), ("E_ALREADY_EXISTS", k % 4 == 0), ("E_CRITICAL_FINDINGS", k % 10 == 3)]
    return p.select("p_partkey", catalog.first_failed(gates).alias("reason"))


@query("""SELECT doc_id, source, lang FROM documents WHERE starts_with(source, 'src1') AND list_contains([lower(lang), lower(source)], 'en') ORDER BY source, doc_id LIMIT 200 OFFSET 5""")
def catalog_page(spark, sf_dir):
    """A page of a listing by namespace prefix and tag; tags compare without case."""
    d = _t(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return catalog.listing(d, prefix=("source", "src1"), tag=("tags", "EN"), order=["source", "doc_id"], limit=900, offset=5, most=200).select("doc_id", "source", "lang")


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new FROM (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_partkey % 4 <> 0) a FULL JOIN
          (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS v FROM part WHERE p_partkey % 7 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def metadata_diff(spark, sf_dir):
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    new = F.when(k % 5 == 0, None).when(k % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    return catalog.metadata_diff(p.where(k % 4 != 0).select(k.alias("k"), F.col("p_type").alias("v")), p.where(k % 7 != 0).select(k.alias("k"), new.alias("v")), "k", "v")


@query("""WITH s AS (SELECT source, max(doc_id) % 3 AS step, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS now FROM documents GROUP BY source)
          SELECT source, CASE step WHEN 0 THEN 'initial' WHEN 1 THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN step <> 1 THEN 1 ELSE 0 END::BIGINT AS versions_added FROM s""")
def lifecycle_states(spark, sf_dir):
    """A source's state by its fingerprint and the one recorded last."""
    docs = _t(spark, sf_dir, "documents")
    ids = docs.groupBy(F.col("source").alias("_s")).agg(F.max("doc_id").alias("m"))
    d = store.fingerprint(docs, "source", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).join(ids, F.col("source").eqNullSafe(F.col("_s")))
    last = F.when(F.col("m") % 3 == 1, F.col("fingerprint")).when(F.col("m") % 3 == 2, F.lit("other"))
    state = catalog.lifecycle(F.col("fingerprint"), last)
    return d.select("source", state.alias("state"), (state != "unchanged").cast("long").alias("versions_added"))


@query("""SELECT source, new_critical, score, baseline, new_critical = 0 AND score >= baseline - 5 AS passed FROM
          (SELECT source, count(*) FILTER (doc_id % 97 = 0) AS new_critical, max(n_chars) % 100 AS score, min(n_chars) % 100 AS baseline FROM documents GROUP BY source)""")
def regression_verdicts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 97 == 0).alias("new_critical"), (F.max("n_chars") % 100).alias("score"), (F.min("n_chars") % 100).alias("baseline"))
    return d.withColumn("passed", catalog.regression_passed(F.col("new_critical"), F.col("score"), F.col("baseline")))


_EVENT_LINE = """concat('{"type":"', CASE turn % 4 WHEN 0 THEN 'assistant' WHEN 1 THEN 'content_block_start' WHEN 2 THEN 'message_delta' ELSE 'noise' END, '","message":{"content":[{"type":"text","text":"',
    role, '"},{"type":"tool_use","name":"Read"}],"usage":{"input_tokens":', turn + 3, ',"output_tokens":', turn, '}},"content_block":{"type":"tool_use","name":"Bash"},"usage":{"output_tokens":', turn * 2, '}', CASE WHEN turn % 5 = 4 THEN '' ELSE '}' END)"""


@query("""WITH e AS (SELECT conv_id, turn % 4 AS k, turn FROM conversations WHERE turn % 5 <> 4)
          SELECT conv_id, count(*) AS events, count(*) FILTER (k IN (0, 1)) AS tool_calls, coalesce(sum(CASE WHEN k = 0 THEN turn + 3 END), 0)::BIGINT AS input_tokens,
            coalesce(sum(CASE k WHEN 0 THEN turn WHEN 2 THEN turn * 2 END), 0)::BIGINT AS output_tokens FROM e GROUP BY conv_id""")
def agent_events(spark, sf_dir):
    """Event lines of agent runs parsed: events, tool calls and token sums; lines that are no JSON are skipped."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", F.expr(_EVENT_LINE).alias("line"))
    return runs.event_totals(c, "conv_id", "line")


@query("""SELECT eval_id, round(least(1.0, a / greatest(1.0, b)), 6) AS process, a < b AS fewer_tools FROM (SELECT user_id % 40 AS eval_id, avg(event_id % 7) FILTER (event_type = 'purchase') AS a,
          avg(event_id % 5) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)""")
def process_scores(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("eval_id")).agg(
        F.avg(F.when(F.col("event_type") == "purchase", F.col("event_id") % 7)).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("event_id") % 5)).alias("b"))
    return e.select("eval_id", F.round(runs.process_score(F.col("a"), F.col("b")), 6).alias("process"), (F.col("a") < F.col("b")).alias("fewer_tools"))


@query("""WITH r AS (SELECT user_id AS q, user_id % 2 = 0 AS should, event_type IN ('purchase', 'view') AS tool, event_type = 'click' AS said, event_type <> 'error' AS ok, value FROM events),
          t AS (SELECT q, should, avg(CASE WHEN should THEN (tool OR said) ELSE tool END::INT) AS rate, coalesce(avg(value) FILTER (ok), 0.0) AS tokens FROM r GROUP BY q, should)
          SELECT q, round(rate, 6) AS rate, round(tokens, 4) AS tokens, CASE WHEN should THEN rate >= 0.5 ELSE rate < 0.5 END AS passed FROM t""")
def trigger_runs(spark, sf_dir):
    """Trigger rates over all runs, token means over successful ones; positives count tool and text, negatives the tool only."""
    kind = F.col("event_type")
    signal = F.when(kind.isin("purchase", "view"), "tool").when(kind == "click", "text").otherwise("none")
    r = _t(spark, sf_dir, "events").select(F.col("user_id").alias("q"), (F.col("user_id") % 2 == 0).alias("should"), signal.alias("signal"), (kind != "error").alias("ok"), "value")
    return runs.trigger_rates(r, "q", "should", "signal", "ok", "value")


@query("""WITH s AS (SELECT doc_id, (n_chars % 10) / 10.0 AS audit, (n_chars % 7) / 7.0 AS functional, (n_chars % 13) / 13.0 AS trig FROM documents)
          SELECT doc_id, array_to_string(list_filter([CASE WHEN audit < 0.7 THEN 'audit' END, CASE WHEN functional < 0.7 THEN 'functional' END, CASE WHEN trig < 0.8 THEN 'trigger' END], lambda x: x IS NOT NULL), ',') AS failing FROM s""")
def failing_dimensions(spark, sf_dir):
    n = F.col("n_chars")
    scores = F.create_map(F.lit("audit"), n % 10 / 10.0, F.lit("functional"), n % 7 / 7.0, F.lit("trigger"), n % 13 / 13.0)
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.map_keys(runs.failing(scores)), ",").alias("failing"))


@query("""WITH w AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'odd' END AS severity FROM events)
          SELECT user_id, arg_min(event_id, (CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END) * 1000000000::BIGINT + event_id) AS worst, min(user_id % 3 + event_id * 0) AS variant FROM w GROUP BY user_id""")
def worst_weaknesses(spark, sf_dir):
    """The worst weakness of each run, the first of equals, and the variant dealt to it."""
    severity = F.element_at(F.array(*map(F.lit, ("high", "low", "medium", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    w = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(runs.severity_rank(severity), "event_id")).alias("worst"))
    return w.withColumn("variant", runs.round_robin(F.col("user_id"), 3))


@query("""SELECT user_id, arg_max(event_type, event_id) AS last_entry, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def history_deltas(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_entry"), F.round(F.max_by("value", "event_id") - F.min_by("value", "event_id"), 6).alias("delta"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'modified' WHEN doc_id % 2 = 0 THEN 'untracked' ELSE 'unchanged' END AS state FROM documents""")
def install_states(spark, sf_dir):
    """Installed files against their records: missing, modified, untracked or unchanged."""
    d, k = _t(spark, sf_dir, "documents"), F.col("doc_id")
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    tracked = d.where((k % 5 == 0) | (k % 3 == 0) | (k % 2 != 0)).select("doc_id", h.alias("recorded"))
    there = d.where(k % 5 != 0).select("doc_id", F.when(k % 3 == 0, F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 256)).otherwise(h).alias("found"))
    return catalog.install_states(tracked, there, "doc_id", "recorded", "found")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN false ELSE turn % 2 = 0 END AS passed, CASE WHEN turn % 3 = 0 THEN true ELSE (turn % 10) / 10.0 < 0.5 END AS uncertain FROM conversations""")
def judge_results(spark, sf_dir):
    """Verdicts re-attached to their assertions by place; an assertion without one fails."""
    c, n = _t(spark, sf_dir, "conversations").select("conv_id", "turn"), F.col("turn")
    told = c.where(n % 3 != 0).select("conv_id", "turn", (n % 2 == 0).alias("passed"), ((n % 10) / 10.0).alias("confidence"))
    return runs.with_verdicts(c, told, ["conv_id", "turn"])


_FRONT = f"""SELECT doc_id, {_pick('t', ["concat('---', chr(10), 'name: ', lang, chr(10), 'k: a---b', chr(10), '---', chr(10), text)", "text", "concat('---', chr(10), 'name: x', chr(10), text)", "concat('--- ', chr(10), 'name: y', chr(10), '---', chr(10), text)"])} FROM documents"""


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('name: ', split_part(t, chr(10), 2)[7:], chr(10), 'k: a---b') WHEN 3 THEN NULL END AS head, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 0 END AS body_start,
           CASE WHEN doc_id % 4 = 0 THEN split_part(t, chr(10), 2)[7:] WHEN doc_id % 4 = 2 THEN 'x' WHEN doc_id % 4 = 3 THEN 'y' END AS name FROM ({_FRONT})""")
def front_matter(spark, sf_dir):
    """The head between lines of three hyphens, where the body starts, and the name by a scan of lines."""
    f = scalars.front_matter(F.col("t"))
    name = F.when(F.col("t").startswith("---"), scalars.named(F.col("t")))
    return _view(spark, sf_dir, _FRONT, "documents").select("doc_id", f["head"].alias("head"), f["body_start"].alias("body_start"), name.alias("name"))


_CODE = ["'x = base64.b64decode(y)'", "'exec(base64.decodebytes(y))'", "'batob(z)'", "'v = atob (z)'", "concat('k = ', chr(39), repeat('Ab1+', 30), chr(39))", "'eval'", "'(v)'", "'EXEC (v)'", "'pass'"]
_SCRIPTS = f"SELECT l_orderkey AS file, l_linenumber AS n, {_pick('line', _CODE, '(l_orderkey + l_linenumber * 4)')} FROM lineitem"


@query(f"""WITH l AS ({_SCRIPTS}), w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM l),
           h AS (SELECT file, n, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(line, {_q(p)}) THEN CASE WHEN regexp_matches(line, {_q(S.EVAL)}) THEN 'CRITICAL' ELSE 'WARNING' END END" for p in S.DECODERS)},
             CASE WHEN regexp_matches(line, {_q(S.LONG_BASE64)}) AND regexp_matches(near, {_q(S.EVAL)}) THEN 'CRITICAL' END], lambda x: x IS NOT NULL)) AS severity FROM w)
           SELECT file, n, severity FROM h""")
def payload_findings(spark, sf_dir):
    """Decoding of base64, and long base64 strings near eval or exec: from the line above to the second below."""
    return catalog.payload_findings(_view(spark, sf_dir, _SCRIPTS, "lineitem"), "file", "n", "line")


_REPLIES = ["text", "concat('Here: ```markdown', chr(10), ' kept ', chr(10), '``` rest')", "concat('a [1, 2] b [3] c')", "'no list ] ['", "concat('```', chr(10), 'x', chr(10), '```')"]
_REPLY = f"SELECT doc_id, {_pick('t', _REPLIES)}, {_pick('name', ['concat(source, chr(47), lang)', repr('My Skill!'), repr('/'), repr('a/b/C_d')])}, {_pick('section', [repr('{"normalized": 0.5}'), repr('{"overall": 0.25, "pass_rate": 1}'), repr('{"error": "x", "overall": 1}'), repr('{"skipped": true, "overall": 1}'), 'NULL'])} FROM documents"


@query(rf"""SELECT doc_id, sha256(regexp_replace(CASE WHEN regexp_matches(t, '(?s)```(?:markdown|md)?\s*\n(.*?)```') THEN regexp_extract(t, '(?s)```(?:markdown|md)?\s*\n(.*?)```', 1) ELSE t END, '^\s+|\s+$', '', 'g')) AS answer,
           CASE WHEN strpos(t, '[') > 0 AND strpos(t, ']') > 0 AND length(t) - strpos(reverse(t), ']') + 1 > strpos(t, '[') THEN substr(t, strpos(t, '['), length(t) - strpos(reverse(t), ']') + 2 - strpos(t, '[')) END AS listed,
           CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'my-skill-' WHEN 2 THEN 'downloaded-skill' ELSE 'c-d' END AS slug, CASE doc_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 END::DOUBLE AS score
           FROM ({_REPLY}) JOIN documents USING (doc_id)""")
def reply_parts(spark, sf_dir):
    """Answers in fences, lists in noisy text, slugs of names, scores of report sections."""
    r = _view(spark, sf_dir, _REPLY, "documents")
    t = F.col("t")
    return r.select("doc_id", F.sha2(scalars.fenced_answer(t), 256).alias("answer"), scalars.bracketed(t).alias("listed"), scalars.slug(F.col("name")).alias("slug"), scalars.section_score(F.col("section")).alias("score"))


@query("""SELECT event_id, user_id FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-03' AND strftime(ts, '%Y-%m-%d') <= '2024-01-25' AND event_type = 'click' AND contains(props, '7') ORDER BY event_id LIMIT 500""")
def log_first(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd"))
    return catalog.log_page(e, "at", "2024-01-03", "2024-01-25", ("event_type", "click"), ("props", "7"), "event_id", 500).select("event_id", "user_id")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a,b' WHEN 2 THEN '' ELSE 'a,b,c,z' END AS targets FROM customer""")
def resolved_targets(spark, sf_dir):
    asked = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in (["all"], ["b", "first", "b"], [], ["z", "all", "a"])]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(catalog.resolved_targets(asked, {"first": "a"}, ["c", "b", "a"]), ",").alias("targets"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'unsafe' WHEN l_partkey % 7 = 0 OR l_suppkey % 5 = 0 THEN 'error' WHEN l_orderkey % 3 = 0 THEN 'skipped' ELSE 'imported' END AS status FROM lineitem) GROUP BY status""")
def import_tally(spark, sf_dir):
    path = F.when(F.col("l_partkey") % 22 == 0, "/etc/x").when(F.col("l_partkey") % 11 == 0, "a/../b").otherwise("skills/a@1/SKILL.md")
    status = catalog.import_status(path, F.col("l_orderkey") % 3 == 0, F.col("l_partkey") % 7 != 0, F.col("l_suppkey") % 5 != 0)
    return _t(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 8 = 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 9 <> 1""")
def registry_update(spark, sf_dir):
    """Values replaced from a table of changes, then keys deleted."""
    o, k = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey")
    changes = o.where((k % 4 == 0) | (k % 8 == 2)).select(k, F.when(k % 4 == 0, "new").alias("o_orderstatus"))
    return catalog.updated(o, changes, "o_orderkey", "o_orderstatus").join(o.where(k % 9 == 1).select("o_orderkey"), "o_orderkey", "left_anti")


@query(f"""WITH f AS ({_FULL}) SELECT doc_id, CASE severity WHEN 'CRITICAL' THEN 'error' ELSE 'warning' END AS level, code AS message FROM f WHERE severity <> 'INFO' UNION ALL
           SELECT doc_id, 'notice', count(*) || CASE WHEN count(*) = 1 THEN ' INFO finding' ELSE ' INFO findings' END || ' suppressed (' || string_agg(DISTINCT code, ', ' ORDER BY code) || ')' FROM f WHERE severity = 'INFO' GROUP BY doc_id""")
def finding_annotations(spark, sf_dir):
    return catalog.annotations(_all_findings(spark, sf_dir), "doc_id")


@query(f"""WITH f AS ({_FULL}), n AS (SELECT doc_id, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'WARNING') AS w FROM f GROUP BY doc_id)
           SELECT doc_id % 25 AS batch, max(CASE WHEN c > 0 THEN 2 WHEN w > 0 THEN 1 ELSE 0 END)::INT AS worst FROM n GROUP BY 1""")
def worst_exit_codes(spark, sf_dir):
    """The worst exit code of each batch of strict audits."""
    n = _all_findings(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "WARNING").alias("w"))
    return n.groupBy((F.col("doc_id") % 25).alias("batch")).agg(F.max(skills.exit_code(F.col("c"), F.col("w"), strict=True)).alias("worst"))


_LINKED = f"SELECT doc_id, {_pick('t', ['concat(chr(91), lang, chr(93), chr(40), repr_a, chr(41), text)', 'concat(text, repr_b)', 'concat(repr_c, repr_d)'])} FROM documents".replace("repr_a", "'a.md#top'").replace("repr_b", "' [x](a/b/c.md) [y](http://e.org/z) [z](#p)'").replace("repr_c", "'[q](a/b.md?v=1) '").replace("repr_d", "'[r](mailto:x) [s](lost.md)'")


@query("""SELECT doc_id, 'a.md' AS target, 'broken' AS problem FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'a/b/c.md', CASE WHEN doc_id % 5 = 0 THEN 'broken' ELSE 'deep' END FROM documents WHERE doc_id % 3 = 1
          UNION ALL SELECT doc_id, 'a/b.md', 'broken' FROM documents WHERE doc_id % 3 = 2 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'lost.md', 'broken' FROM documents WHERE doc_id % 3 = 2""")
def broken_links(spark, sf_dir):
    d, k = _view(spark, sf_dir, _LINKED, "documents"), F.col("doc_id")
    there = F.array_compact(F.array(F.when(k % 2 == 0, "a.md"), F.when(k % 5 != 0, "a/b/c.md"), F.when(k % 7 == 0, "a/b.md")))
    return catalog.broken_links(d, d.select("doc_id", F.explode(there).alias("path")), "doc_id", "t", "path")


_JSON = [repr('{"weaknesses": [{"category": "audit", "severity": "low", "description": "d"}, {"description": "e"}]}'), repr('{"weaknesses": []}'), "'no json'", repr('{"weaknesses": [{}]}')]
_REPORTS = f"SELECT conv_id, turn, {_pick('reply', _JSON, 'turn')} FROM conversations"


@query("""WITH c AS (SELECT conv_id, turn, turn % 4 AS k FROM conversations) SELECT conv_id, turn, 'audit' AS category, 'low' AS severity, 'd' AS description FROM c WHERE k = 0 UNION ALL SELECT conv_id, turn, 'functional', 'medium', 'e' FROM c WHERE k = 0
          UNION ALL SELECT conv_id, turn, 'functional', 'high', 'Unable to parse structured failure analysis' FROM c WHERE k IN (1, 2) UNION ALL SELECT conv_id, turn, 'functional', 'medium', 'Unknown weakness' FROM c WHERE k = 3""")
def parsed_weaknesses(spark, sf_dir):
    return _view(spark, sf_dir, _REPORTS, "conversations").select("conv_id", "turn", F.inline(runs.weaknesses(F.col("reply")))).select("conv_id", "turn", "category", "severity", "description")


_ITEMS = f"SELECT conv_id, turn, {_pick('item', [repr('{"id": 1, "prompt": "p"}'), repr('{"id": 1}'), repr('{}'), repr('[1]'), repr('{"prompt": null}')], 'turn')} FROM conversations"


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN 'prompt' WHEN 2 THEN 'id,prompt' WHEN 4 THEN 'id' END AS missing FROM conversations""")
def eval_case_errors(spark, sf_dir):
    return _view(spark, sf_dir, _ITEMS, "conversations").select("conv_id", "turn", F.array_join(runs.case_errors(F.col("item"), ["id", "prompt"]), ",").alias("missing"))


@query("""WITH b AS (SELECT user_id % 30 AS eval_id, round(avg(event_id % 9) FILTER (event_type = 'view'), 4) AS view, round(avg(event_id % 9) FILTER (event_type = 'click'), 4) AS click FROM events GROUP BY 1)
          SELECT * FROM b UNION ALL SELECT NULL, ((2 * sum(round(view * 10000)::BIGINT) + count(view)) // (2 * count(view))) / 10000, ((2 * sum(round(click * 10000)::BIGINT) + count(click)) // (2 * count(click))) / 10000 FROM b""")
def side_by_side(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("eval_id"), "event_type", (F.col("event_id") % 9).alias("v"))
    return runs.side_by_side(e, "eval_id", "event_type", "v", "view", "click")


@query("""SELECT source, arg_max(doc_id, (lang = 'en', n_chars, doc_id)) AS baseline FROM documents GROUP BY source""")
def baseline_lookup(spark, sf_dir):
    """The baseline of each source: the latest marked one, else the newest."""
    newest = F.struct((F.col("lang") == "en").alias("latest"), "n_chars", "doc_id")
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.max(newest)["doc_id"].alias("baseline"))
