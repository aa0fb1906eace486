"""Queries that write a store in the shared folder and read it back, and the same in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import audit, catalog, formats, history, manifests, syntax, transfer
from lodestack.operators.changelog import ChangeLog
from lodestack.operators.index import SearchIndex
from lodestack.plans import reports  # noqa: F401  registers the searches whose SQL holds here too
from lodestack.plans.catalogue import ALL_RULES, ORACLE, _findings_sql, _t, query
from lodestack.sources import archives
from lodestack.sources.tables import Bucketed, new_folder, spread


def _index(spark, sf_dir):
    """Documents in two batches, by language; tags are language and source."""
    docs = _t(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    index = SearchIndex(spark, new_folder(spark, "search-index"), stored={"source": "string", "n_chars": "bigint", "tags": "array<string>"}, buckets=8)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(docs.where(english))
    index.add(docs.where(~english))
    return index


@query(ORACLE["search_page"])
def index_search(spark, sf_dir):
    """search_page from a persistent inverted index, without a scan of texts."""
    return _index(spark, sf_dir).page("Of-of  was", tag=("tags", "EN"), limit=9000, offset=1, created="n_chars").withColumnRenamed("id", "doc_id")


@query(ORACLE["catalog_search"].replace("ORDER BY rank DESC, doc_id LIMIT 20", "ORDER BY rank DESC, n_chars DESC, doc_id LIMIT 20").replace("SELECT doc_id, string_split", "SELECT doc_id, n_chars, string_split").replace("SELECT doc_id, len([x FOR", "SELECT doc_id, n_chars, len([x FOR"))
def index_top(spark, sf_dir):
    """The best texts with two terms; layers that can't reach them are not read."""
    return _index(spark, sf_dir).page("license version", limit=20, created="n_chars").withColumnRenamed("id", "doc_id")


@query("""WITH w AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE source = 'src1')
          SELECT count(*) AS total FROM w WHERE list_contains(w, 'the')""")
def index_count(spark, sf_dir):
    """How many entries of a namespace a search finds."""
    return _index(spark, sf_dir).count("the", namespace=("source", "src1"))


@query("""WITH w AS (SELECT doc_id, source, n_chars, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE source IS DISTINCT FROM 'src1'),
          c AS (SELECT doc_id, n_chars, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS f FROM w),
          s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f > 0) AS d FROM c)
          SELECT doc_id, round(greatest(1e-6, ln((docs - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)), 10) AS rank
          FROM c, s WHERE f > 0 ORDER BY rank DESC, n_chars DESC, doc_id LIMIT 100""")
def index_after_removal(spark, sf_dir):
    """A search after all entries of a source were removed, and those of another removed and added again."""
    index, docs = _index(spark, sf_dir), _t(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    index.remove(docs.where("source IN ('src1', 'src2')"))
    index.add(docs.where("source = 'src2'"))
    return index.page("the", limit=100, created="n_chars").withColumnRenamed("id", "doc_id")


#: Manifests and front matter of parts: name, brand, size and price are a table's own values.
_YAML = """concat('apiVersion: example.io/v1', chr(10), 'kind: Skill', chr(10), 'metadata:', chr(10), '  name: org/part-', p_partkey, chr(10), '  version: 1.', p_size, '.0', chr(10),
    '  description: "', p_name, ': ', p_brand, '"', chr(10), '  tags:', chr(10), '  - ', p_brand, chr(10), '  - ', p_type, ' # type', chr(10), 'spec:', chr(10), '  content:', chr(10),
    '    inline: |', chr(10), '      # ', p_name, chr(10), '      ', p_brand, chr(10), '  parameters:', chr(10), '    - name: price', chr(10), '      type: number', chr(10), '      default: ', p_retailprice, chr(10))"""
_HEAD = """concat('---', chr(10), 'name: part-', p_partkey, chr(10), 'description: >-', chr(10), '  ', p_name, chr(10), '  of ', p_brand, chr(10), 'about:', chr(10), '  namespace: org', chr(10), '  version: 2.', p_size, '.1', chr(10), '  tags: [', p_type, ', "', p_brand, '"]', chr(10), '---', chr(10), chr(10), p_name, chr(10))"""


def _part_files(spark, sf_dir):
    parts, economy = _t(spark, sf_dir, "part"), F.col("p_type") == "ECONOMY"
    return parts.select(
        F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("folder"), F.when(economy, "SKILL.md").otherwise("skill.yaml").alias("name"), F.when(economy, F.expr(_HEAD)).otherwise(F.expr(_YAML)).alias("text")
    )


@query("""SELECT 'parts/' || p_partkey AS folder, CASE WHEN p_type = 'ECONOMY' THEN 'markdown' ELSE 'yaml' END AS source, 'org/part-' || p_partkey AS name,
                 CASE WHEN p_type = 'ECONOMY' THEN '2.' || p_size || '.1' ELSE '1.' || p_size || '.0' END AS version,
                 CASE WHEN p_type = 'ECONOMY' THEN p_name || ' of ' || p_brand ELSE p_name || ': ' || p_brand END AS description,
                 CASE WHEN p_type = 'ECONOMY' THEN p_type || ',' || p_brand ELSE p_brand || ',' || p_type END AS tags,
                 CASE WHEN p_type <> 'ECONOMY' THEN p_retailprice::VARCHAR END AS price,
                 CASE WHEN p_type = 'ECONOMY' THEN p_name ELSE '# ' || p_name || chr(10) || p_brand || chr(10) END AS content, NULL::VARCHAR AS error FROM part""")
def manifest_rows(spark, sf_dir):
    """Manifests and front matter read as columns."""
    m = manifests.load(_part_files(spark, sf_dir), "example.io/v1", "about")
    return m.select("folder", "source", "name", "version", "description", F.array_join("tags", ",").alias("tags"), F.get("params", F.lit(0))["default"].alias("price"), "content", "error")


@query(r"""WITH f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
          SELECT doc_id::VARCHAR AS folder, 'STR-004' AS code, 'no front matter' AS reason FROM f WHERE regexp_replace(ls[1], '^\s+|\s+$', '', 'g') <> '---' UNION ALL
          SELECT 'c' || c_custkey, 'STR-001', 'no folder' FROM customer UNION ALL SELECT 's' || s_suppkey, 'STR-002', 'no SKILL.md' FROM supplier UNION ALL
          SELECT 'p' || p_partkey, 'STR-004', CASE WHEN p_size < 20 THEN 'no YAML' WHEN p_size < 30 THEN 'not closed' ELSE 'no mapping' END FROM part WHERE p_size < 40""")
def skill_loading(spark, sf_dir):
    """Skills that can't be audited: documents as SKILL.md, customers without a folder, suppliers without the file, parts with bad front matter."""
    d, c, s, p = (_t(spark, sf_dir, t) for t in ("documents", "customer", "supplier", "part"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string")).alias("folder")
    head = F.when(F.col("p_size") < 20, F.expr("concat('---', chr(10), 'a: ', p_name, ': ', p_brand, chr(10), '---')")).when(F.col("p_size") < 30, F.expr("concat('---', chr(10), 'a: ', p_name)"))
    head = head.when(F.col("p_size") < 40, F.expr("concat('---', chr(10), '- ', p_name, chr(10), '---', chr(10))")).otherwise(F.expr("concat('---', chr(10), 'a: ', p_name, chr(10), '---', chr(10))"))
    files = d.select(key("", "doc_id"), F.lit("SKILL.md").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    files = files.unionByName(s.select(key("s", "s_suppkey"), F.lit("notes.md").alias("name"), F.col("s_name").alias("text"))).unionByName(p.select(key("p", "p_partkey"), F.lit("SKILL.md").alias("name"), head.alias("text")))
    return manifests.loading_errors(files.select("folder").unionByName(c.select(key("c", "c_custkey"))), files)


def _part_entries(spark, sf_dir):
    text = F.concat_ws("\n", "p_name", "p_brand")
    return _t(spark, sf_dir, "part").select(
        "p_size", "p_type", F.expr("concat('org/part-', p_partkey)").alias("name"), F.expr("concat('1.', p_size, '.0')").alias("version"), F.sha2(text, 256).alias("hash"), text.alias("content"), F.expr(_YAML).alias("manifest")
    )


def _exported(spark, entries):
    """Archives of both kinds: zip files of one type of part, tar files of the others."""
    path, entries = new_folder(spark, "archives"), spread(entries)  # an archive a task: reading them back has as many
    zipped = F.col("p_type") == "ECONOMY"
    archives.export_archives(entries.where(zipped), path, "zip")
    archives.export_archives(entries.where(~zipped), path, "tar.gz")
    return path


@query("""SELECT 'org/part-' || p_partkey AS name, '1.' || p_size || '.0' AS version, 'imported' AS status, sha256(p_name || chr(10) || p_brand) AS hash FROM part""")
def archive_round_trip(spark, sf_dir):
    """Entries exported to archives and imported into an empty catalogue."""
    none = spark.createDataFrame([], "name string, version string")
    out = transfer.import_path(spark, _exported(spark, _part_entries(spark, sf_dir)), none, "example.io/v1", "about")
    return out.select("name", "version", "status", F.sha2("content", 256).alias("hash"))


@query("""SELECT CASE WHEN p_size > 45 THEN 'error' WHEN p_brand = 'Brand#2' THEN 'skipped' ELSE 'imported' END AS status,
                 CASE WHEN p_size > 45 THEN 'SKILL.md not found in archive' END AS error, count(*) AS n FROM part GROUP BY ALL""")
def archive_import(spark, sf_dir):
    """The tally of an import: entries without content are errors, those of a brand are known."""
    entries = _part_entries(spark, sf_dir)
    path = _exported(spark, entries.withColumn("content", F.when(F.col("p_size") <= 45, F.col("content"))))
    known = _t(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.expr("concat('org/part-', p_partkey)").alias("name"), F.expr("concat('1.', p_size, '.0')").alias("version"))
    return transfer.import_path(spark, path, known, "example.io/v1", "about").groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


#: A script of each part: names, brands and prices are the table's own.
_SCRIPT = """concat('from pickle import loads as ', replace(p_name, ' ', '_'), chr(10), 'import subprocess as run_', p_partkey, chr(10), replace(p_name, ' ', '_'), '(x)', chr(10),
    'run_', p_partkey, '.call("', p_brand, '", shell=', CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END, ')', chr(10), 'import yaml', chr(10), 'yaml.load(x', CASE WHEN p_retailprice > 1000 THEN ', Loader=y' ELSE '' END, ')', chr(10),
    CASE WHEN p_type = 'ECONOMY' THEN 'print(eval("1"))' ELSE 'print(obj.eval("1"))' END, chr(10), 'import base64', chr(10), 'base64.b64decode("', p_name, '" + ', CASE WHEN p_brand = 'Brand#2' THEN 'x' ELSE '"="' END, ')', chr(10))"""


@query("""SELECT p_partkey, u.* FROM part, (VALUES (3, 'SEC-006-AST', 'Unsafe deserialization: pickle.loads'), (4, 'SEC-003-AST', 'Subprocess with shell=True'), (6, 'SEC-006-AST', 'Unsafe deserialization: yaml.load without Loader='),
          (7, 'SEC-007-AST', 'Dangerous builtin: eval()'), (9, 'SEC-008-AST', 'Base64 decode of literal-concatenation')) u(line_number, code, title)
          WHERE CASE line_number WHEN 3 THEN true WHEN 4 THEN p_size > 25 WHEN 6 THEN NOT p_retailprice > 1000 WHEN 7 THEN p_type = 'ECONOMY' ELSE p_brand <> 'Brand#2' END""")
def strict_syntax(spark, sf_dir):
    """Strict rules on scripts made of parts: aliased imports, keyword arguments, sums of literals."""
    files = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_SCRIPT).alias("script"))
    return syntax.strict_findings(files, "p_partkey", "script").select(F.col("path").alias("p_partkey"), "line_number", "code", "title")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
          SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM o WHERE o_orderstatus <> 'F'
          UNION ALL SELECT o_orderkey, 'back', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def change_log(spark, sf_dir):
    """A store of orders after puts, an update, a compaction, deletes and puts of what was deleted."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    log = ChangeLog(spark, new_folder(spark, "change-log"), "o_orderkey bigint, o_orderstatus string, o_totalprice double", "o_orderkey", buckets=8)
    log.put(o)
    log.update(o.where("o_totalprice > 300000 AND o_orderstatus <> 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderstatus"])
    log.compact()
    log.delete(o.where("o_orderpriority = '5-LOW' OR o_orderstatus = 'F'"))
    log.put(o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("back")))
    return log.read()


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR row_number() OVER (PARTITION BY o_orderkey ORDER BY copy) > 1 THEN 'E_ALREADY_EXISTS' ELSE 'added' END AS status
          FROM orders, (VALUES (1), (2)) v(copy) WHERE copy = 1 OR o_orderstatus = 'P'""")
def push_to_store(spark, sf_dir):
    """Rows pushed to a store that has some of them; some are pushed twice at once."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    log = ChangeLog(spark, new_folder(spark, "push"), "o_orderkey bigint, o_orderstatus string, o_totalprice double", "o_orderkey", buckets=8)
    log.put(o.where("o_orderpriority = '1-URGENT'"))
    new = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return log.put_new(new.unionByName(new.where("o_orderstatus = 'P'")))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0)""")
def key_lookup(spark, sf_dir):
    """Orders of some customers, from a table bucketed by customer: only the keys are shuffled."""
    table = Bucketed(spark, new_folder(spark, "orders"), "o_custkey bigint, o_orderkey bigint, o_totalprice double", "o_custkey", 8)
    table.append(_t(spark, sf_dir, "orders"), spread_by="o_orderkey", spread=2)
    keys = _t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table.lookup(keys).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
          SELECT e.event_id, v.value AS valid FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type <> 'purchase'""")
def version_as_of(spark, sf_dir):
    """The value of each user's last purchase at the time of each other event."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    versions = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("valid"))
    return history.as_of(e.where("event_type <> 'purchase'"), versions, "user_id", "ts", ["valid"]).select("event_id", "valid")


@query("""SELECT user_id, event_id, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id, value) AS valid_to FROM events WHERE event_type = 'purchase'""")
def version_intervals(spark, sf_dir):
    """From when to when each user's purchase was the last."""
    e = _t(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return history.intervals(e, "user_id", "ts").drop("ts")


@query("""WITH g AS (SELECT event_type AS run_id, extract(hour FROM ts)::INT AS cycle, max(value) * CASE WHEN extract(hour FROM ts)::INT < 6 THEN 2 ELSE 1 END AS s FROM events GROUP BY event_type, extract(hour FROM ts)::INT)
          SELECT run_id, count(*) AS cycles, arg_min(s, cycle) AS first, arg_max(s, cycle) AS last, max(s) AS best, arg_min(cycle, struct_pack(a := -s, b := cycle)) AS best_cycle FROM g GROUP BY run_id""")
def run_provenance(spark, sf_dir):
    """Runs of cycles written by run and cycle, of which the first were written again with other scores."""
    e, path = _t(spark, sf_dir, "events"), new_folder(spark, "runs")
    cycles = e.select(F.col("event_type").alias("run_id"), F.hour("ts").alias("cycle"), F.col("value").alias("score")).repartition("run_id", "cycle")
    history.write_cycles(cycles, path)
    history.write_cycles(cycles.where("cycle < 6").withColumn("score", F.col("score") * 2), path)
    return history.runs(history.read_cycles(spark, path), "score")


_STYLED = """concat('---', chr(10), 'description: ', p_name, chr(10), 'model: ', p_type, chr(10), CASE WHEN p_retailprice > 1000 THEN concat('paths:', chr(10), '  - ', p_brand, chr(10)) ELSE '' END,
    CASE WHEN p_size > 25 THEN concat('disable-model-invocation: true', chr(10)) ELSE '' END, '---', chr(10), 'body of ', p_name)"""


@query("""WITH p AS (SELECT p_partkey, p_size > 25 AS off, p_retailprice > 1000 AS path, 'description: ' || p_name AS d, 'model: ' || p_type AS m, chr(10) || '  - "' || p_brand || '"' AS items, p_brand,
                            'body of ' || p_name || chr(10) AS body FROM part),
          s AS (SELECT p_partkey, body, 'plain' AS style, concat_ws(chr(10), d, m, CASE WHEN path THEN 'paths:' || items END, CASE WHEN off THEN 'disable-model-invocation: true' END) AS head FROM p UNION ALL
                SELECT p_partkey, body, 'switch', concat_ws(chr(10), d, CASE WHEN path THEN 'globs:' || items END, CASE WHEN off OR path THEN 'alwaysApply: false' ELSE 'alwaysApply: true' END) FROM p UNION ALL
                SELECT p_partkey, body, 'trigger', concat_ws(chr(10), d, CASE WHEN off THEN 'trigger: manual' WHEN path THEN 'trigger: glob' ELSE 'trigger: always_on' END, CASE WHEN path THEN 'globs:' || items END) FROM p UNION ALL
                SELECT p_partkey, body, 'inclusion', concat_ws(chr(10), 'name: part-' || p_partkey, d, CASE WHEN off THEN 'inclusion: manual' WHEN path THEN 'inclusion: fileMatch' ELSE 'inclusion: always' END, CASE WHEN path THEN 'fileMatchPattern: "' || p_brand || '"' END) FROM p UNION ALL
                SELECT p_partkey, body, 'paths', CASE WHEN path THEN 'applyTo: "' || p_brand || '"' END FROM p)
          SELECT p_partkey, style, CASE WHEN head IS NULL THEN body ELSE '---' || chr(10) || head || chr(10) || '---' || chr(10) || chr(10) || body END AS translated FROM s""")
def front_matter_styles(spark, sf_dir):
    """Front matter of parts, translated to each style."""
    texts = _t(spark, sf_dir, "part").select("p_partkey", F.expr("concat('part-', p_partkey)").alias("name"), F.expr(_STYLED).alias("t"))
    return formats.translate(texts, "name", "t", ["model"]).select("p_partkey", "style", "translated")


def _escaped(x, more=""):
    e = f"replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
    return f"replace(replace({e}, ':', '%3A'), ',', '%2C')" if more else e


@query(f"""WITH {_findings_sql(ALL_RULES)} SELECT f.doc_id, '::' || CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'notice' END || ' file=' || {_escaped("source || ':' || f.doc_id || ',100%.md'", "p")}
           || ',line=' || line_number || ',title=' || {_escaped("code || ': ' || title", "p")} || '::' || {_escaped("line")} AS command
           FROM (SELECT f.*, ls[line_number] AS line, source FROM f JOIN (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) USING (doc_id)) f""")
def annotation_lines(spark, sf_dir):
    """Findings as commands of a continuous-integration log, with file, line and the line's text, escaped."""
    docs = _t(spark, sf_dir, "documents")
    found = audit.findings(docs, ALL_RULES).join(docs.select("doc_id", "source", audit.lines(F.col("text")).alias("ls")), "doc_id")
    level = F.when(F.col("severity") == "CRITICAL", "error").when(F.col("severity") == "WARNING", "warning").otherwise("notice")
    file = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(",100%.md"))
    line = F.get("ls", (F.col("line_number") - 1).cast("int"))
    return found.select("doc_id", catalog.workflow_line(level, file, F.col("line_number"), F.concat_ws(": ", "code", "title"), line).alias("command"))


@query(f"""WITH {_findings_sql(ALL_RULES)}, b AS (SELECT doc_id, severity, severity || ' (' || count(*) || ')' || chr(10) || string_agg('  ' || code || ' line ' || line_number || ': ' || title, chr(10) ORDER BY line_number, code, title) AS t FROM f GROUP BY doc_id, severity)
           SELECT doc_id, string_agg(t, chr(10) ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) AS text FROM b GROUP BY doc_id""")
def finding_report(spark, sf_dir):
    """Findings of each document as a text, grouped by severity."""
    return catalog.report(audit.findings(_t(spark, sf_dir, "documents"), ALL_RULES), "doc_id")
