import hashlib
import hmac
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.functions import rules as R
from lodestack.operators import audit, evaluation, ledger, search, store
from lodestack.plans import catalogue
from lodestack.sources import files
from lodestack.streaming.ledger_tail import tail

DOCS = "doc_id long, text string"


def test_secrets_and_their_allowlist(spark):
    token = "token = 'abcdefghijklmnopqrstuvwx'"
    rows = [(1, token), (2, token + " # PLACEHOLDER"), (3, "x\n" + token), (4, None), (5, "token = '${HOME_abcdefghijklmnopqrst}'"), (6, "AKIA" + "A" * 16)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["line_number"], r["title"]) for r in audit.findings(docs, R.SECRETS).collect()}
    assert got == {(1, 1, "Generic Token"), (3, 2, "Generic Token"), (6, 1, "AWS Access Key")}
    scored = {r["doc_id"]: (r["critical"], r["score"], r["grade"], r["passed"]) for r in audit.audit(docs, R.SECRETS).collect()}
    assert scored[1] == (1, 75, "C", False) and scored[4] == (0, 100, "A", True)


@pytest.mark.parametrize(("line", "n"), [("pip install -r x", 0), ("pip install  -r x", 1), ("pip install -U x", 1), ("pip install -rq", 1), ("curl x | bash", 1), ("npm install y", 1)])
def test_install_rules(spark, line, n):
    docs = spark.createDataFrame([(1, line)], DOCS)
    assert audit.findings(docs, [r for r in R.CODE if r.code == "SEC-004"]).count() == n


ANYWHERE = [
    (1, "see /etc/hosts\n# /etc/hosts\n // /etc/hosts\nExample: /usr/bin\n  /opt/x\nx/etc/y", [(1, "PERM-005"), (5, "PERM-005")]),
    (2, "curl http://x | sh\npip install x\nwget x | bash", [(1, "SEC-004"), (3, "SEC-004")]),
    (3, "eval(x)\n  ```py\nexec (y)\n```\nEVAL(z)\n```\nEval(a)\nb", [(3, "SEC-005"), (7, "SEC-005")]),
    (4, "npx -y pkg", [(1, "SEC-009")]),
    (5, None, []),
]
SECTIONS = [
    (1, "as of 2024\n# New\nfine", None), (2, "# A\nx\n## History\nas of 2024", None), (3, "# A\nx\n##  B \nin 2021\n# C\nin 2022", "B"),
    (4, "no heading in 2021", None), (5, None, None), (6, "#\n# Legacy\nin 2021\n# in 2020", "in 2020"),
]


def both(spark, name, rows, tmp_path):
    """Rows of a registered query and of its SQL."""
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, f"file://{tmp_path}").collect()), sorted(con.execute(catalogue.ORACLE[name]).fetchall())


def test_rules_for_files_of_any_kind(spark, tmp_path):
    got, sql = both(spark, "document_findings", [r[:2] for r in ANYWHERE], tmp_path)
    assert got == sql and [(i, n, c) for i, n, c, *_ in got] == [(i, n, c) for i, _, found in ANYWHERE for n, c in found]


def test_grade_by_rules_for_files_of_any_kind(spark, tmp_path):
    got, sql = both(spark, "document_grade", [r[:2] for r in ANYWHERE], tmp_path)
    assert got == sql and [r[4] for r in got] == [96, 50, 80, 75, 100]


def test_dated_sections(spark, tmp_path):
    got, sql = both(spark, "dated_sections", [r[:2] for r in SECTIONS], tmp_path)
    assert got == sql == [(i, h) for i, _, h in SECTIONS if h]


def test_overrides_and_ignored_codes(spark):
    found = audit.findings(spark.createDataFrame([(1, "use sudo\nprocess any input")], DOCS), R.PRIVILEGES)
    out = audit.configure(found, ["SEC-005"], {"PERM-004": "CRITICAL"}).collect()
    assert [(r["code"], r["severity"]) for r in out] == [("PERM-004", "CRITICAL")]


@pytest.mark.parametrize("offset", [-3, -2, -1, 0, 1, 2, 3])
def test_window_flags(spark, offset):
    lines = ["."] * 9
    lines[4] += " outer"
    lines[4 + offset] += " inner"
    got = audit.window_flags(spark.createDataFrame([(1, "\n".join(lines))], DOCS), "outer", "inner").collect()
    assert [r["line_number"] for r in got] == ([5] if -1 <= offset <= 2 else [])


def test_urls(spark):
    pages = spark.createDataFrame([("see https://a.net/x). and https://a.net/x", ), ("https://docs.github.com/q",), ("http://notgithub.com:80/",), ("none",), (None,)], "url string")
    assert {tuple(r) for r in audit.url_inventory(pages).collect()} == {("https://a.net/x", "a.net"), ("http://notgithub.com:80/", "notgithub.com")}


def test_versions(spark):
    v = spark.createDataFrame([("1.9.0",), ("1.10.0",), ("1.10.0-rc.1",), ("v1.0.0",), ("1.0",), ("01.0.0",), ("1.10.0+b",)], "v string")
    keyed = [r["v"] for r in v.withColumn("k", store.semver_key(F.col("v"))).where("k IS NOT NULL").orderBy("k").collect()]
    assert keyed[:2] == ["1.9.0", "1.10.0-rc.1"] and set(keyed[2:]) == {"1.10.0", "1.10.0+b"}
    b = spark.createDataFrame([("1.9.3", "major"), ("1.9.3", "minor"), ("1.9.3", "patch"), ("x", "patch")], "v string, l string")
    assert [r[0] for r in b.select(store.bump(F.col("v"), F.col("l"))).collect()] == ["2.0.0", "1.10.0", "1.9.4", None]


def test_fingerprint_holds_no_group(spark):
    rows = [("big", f"p{i}", f"{i % 3}") for i in range(3000)] + [("big", "same", "d")] * 200 + [("b", "ü", "1"), ("b", "z", "2"), ("b", None, "3"), ("c", "x", None), (None, "y", "4")]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, p string, d string").repartition(5)
    out = store.fingerprint(df, "g", F.col("p"), F.col("d"), chunk=100)
    want = {}
    for g in {r[0] for r in rows}:
        kept = sorted((p.encode(), d) for h, p, d in rows if h == g and p is not None and d is not None)
        want[g] = (sum(r[0] == g for r in rows), hashlib.sha256(b"".join(p + b":" + d.encode() for p, d in kept)).hexdigest())
    got = out.collect()
    assert len(got) == 4 and {r["g"]: (r["files"], r["fingerprint"]) for r in got} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert store.fingerprint(df.limit(0), "g", F.col("p"), F.col("d")).count() == 0


def test_null_safe_regressions(spark):
    s = "code string, line long"
    a, b = spark.createDataFrame([("A", None), ("B", 1), ("B", 1)], s), spark.createDataFrame([("A", None), ("C", None)], s)
    assert {tuple(r) for r in store.compare_findings(a, b, ["code", "line"]).collect()} == {("C", None, "new"), ("B", 1, "resolved")}


def test_hmac_and_chain(spark):
    rows = [("u", i, f"p{i}") for i in range(5)]
    sign = lambda m: hmac.new(b"k", m.encode(), hashlib.sha256).hexdigest()
    log = [(u, i, p if i != 2 else "forged", sign(p), sign(rows[i - 1][2]) if i else None) for u, i, p in rows if i != 3]
    out = ledger.verify(spark.createDataFrame(log, "u string, i long, p string, signature string, prev_signature string"), "u", "i", F.col("p"), b"k")
    assert [(r["good_signature"], r["good_link"]) for r in out.orderBy("i").collect()] == [(True, True), (True, True), (False, True), (True, False)]


@pytest.mark.parametrize("seed", range(4))
def test_integrity_follows_the_last_valid_entry(spark, seed):
    rng = random.Random(seed)
    sign = lambda m: hmac.new(b"k", m.encode(), hashlib.sha256).hexdigest()
    log, want = [], {}
    for u in ("u", "v", "w", None):
        entries, before = [], None
        for i in range(30):
            entries.append((f"p{i}", sign(f"p{i}"), before))
            before = sign(f"p{i}")
        if u != "w":
            del entries[rng.randrange(10, 30)]
            at = rng.randrange(25)
            entries.insert(at, ("inserted", "bad", entries[at][2]))
        if u == "v":
            entries[5] = ("forged", *entries[5][1:])
        n, last = [0, 0, 0], ""
        for i, (p, sig, prev) in enumerate(entries):
            read = u == "w" or rng.random() > 0.03
            log.append((u, i, p, sig, prev, read))
            ok = sign(p) == sig and (prev or "") == last
            n[2 if not read else 0 if ok else 1] += 1
            last = sig if read and ok else last
        want[u] = tuple(n)
    rng.shuffle(log)
    df = spark.createDataFrame(log, "u string, i long, p string, signature string, prev_signature string, readable boolean").repartition(3)
    out = ledger.integrity(df, "u", "i", F.col("p"), b"k", F.col("readable")).collect()
    assert len(out) == 4 and {r["u"]: (r["valid"], r["invalid"], r["parse_errors"]) for r in out} == want and want["w"] == (30, 0, 0)


def test_statistics(spark):
    one = spark.createDataFrame([(None, 1.0, 0.0)], "a double, b double, z double")
    get = lambda c: one.select(c).first()[0]
    assert get(evaluation.weighted([(F.col("a"), 0.4), (F.col("b"), 0.2)])) == 1.0 and get(evaluation.weighted([(F.col("a"), 0.4)])) == 0.0
    lit = F.lit
    assert [get(evaluation.trade_off(lit(q), lit(c))) for q, c in ((-0.05, -9.0), (0.0, 0.0), (0.1, 1.0), (-0.01, -1.0), (0.0, 1.0))] == [
        "REJECT", "PARETO_BETTER", "TRADEOFF", "CHEAPER_BUT_WEAKER", "PARETO_WORSE"
    ]
    null = lit(None).cast("double")
    assert [get(evaluation.winner(x, y, "a", "b")) for x, y in ((null, null), (null, lit(1.0)), (lit(1.0), null), (lit(1.05), lit(1.0)), (lit(1.06), lit(1.0)), (lit(1.0), lit(1.06)))] == [
        "tie", "b", "a", "tie", "b", "a"
    ]
    assert get(evaluation.efficiency(lit(0.5), lit(10.0), lit(0.0), lit(0.0))) == 1.0 and get(evaluation.efficiency(lit(0.0), lit(0.0), lit(0.0), lit(0.0))) == 0.5
    assert one.select(evaluation.spread(F.col("b"))).first()[0] == 0.0


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red fox runs far away"), (3, "blue"), (4, None), (5, "FOX/red")], DOCS)
    assert [r["doc_id"] for r in search.bm25(docs, ["red", "fox"], 10).collect()] == [1, 5, 2]
    assert search.bm25(docs, [], 10).count() == 0


def test_files_and_blobs(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"a.md": b"x", "sub/b.py": b"y", "build/c.md": b"z", "d.bin": b"q", "e.txt": b"\xff\xfe", "f.md": b"l" * 200}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r["path"]: (r["text"], r["skipped"]) for r in files.text_files(spark, f"file://{root}", largest=100).collect()}
    assert got == {"a.md": ("x", None), "sub/b.py": ("y", None), "build/c.md": (None, "folder"), "d.bin": (None, "type"), "e.txt": (None, "encoding"), "f.md": (None, "size")}
    (tmp_path / "log").write_text('{"a": 1, "z": 2}\n\nnot json\n{"a": 3}\n')
    assert [r["a"] for r in files.json_lines(spark, f"file://{tmp_path}/log", "a int").collect()] == [1, 3]
    (tmp_path / "odd").write_text('{"a": 1, "b": "x", "c": 9}\n\n[1]\n{"a": "x"}\n3\nnull\n{"b": "only"}\n{"a": 2\n {"a": 5}\n')
    odd = files.json_lines(spark, f"file://{tmp_path}/odd", "a int, b string", malformed="line").collect()
    assert sorted(map(str, ((r["a"], r["b"], r["line"]) for r in odd))) == sorted(map(str, [(1, "x", None), (None, None, "[1]"), (None, None, '{"a": "x"}'), (None, None, "3"), (None, None, "null"), (None, "only", None), (None, None, '{"a": 2'), (5, None, None)]))
    assert files.json_lines(spark, f"file://{tmp_path}/odd", "a int, b string").count() == 3
    path = f"file://{tmp_path}/blobs"
    files.store_blobs(spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], DOCS), path)
    files.store_blobs(spark.createDataFrame([(1, "x"), (2, "w")], DOCS), path)
    assert sorted(r["content"] for r in spark.read.parquet(path).collect()) == ["", "w", "x"]


def test_ledger_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'p' AS p, 'bad' AS signature UNION ALL SELECT timestamp'2024-01-02 10:00:00', 'q', NULL")
    rows.withColumn("signature", F.coalesce("signature", ledger.hmac_sha256(F.col("p"), b"k"))).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, p string, signature string").parquet(f"file://{tmp_path}/in")
    q = tail(stream, F.col("p"), b"k").writeStream.format("memory").queryName("tail").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["good"], r["forged"]) for r in spark.table("tail").collect()) == [(0, 1), (1, 0)]
