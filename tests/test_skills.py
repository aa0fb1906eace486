import pytest
from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.operators import catalog, evaluation, runs, skills, store
from lodestack.sources import files


def test_versions_sort_by_precedence(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0", "1.9.0", "1.10.0", "99999999999999999999.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)] + [("v1.0.0",), ("1.0",), ("01.0.0",)], "v string")
    assert [r["v"] for r in rows.withColumn("k", store.semver_key(F.col("v"))).where("k IS NOT NULL").orderBy("k").collect()] == order
    got = {r["v"]: r["n"] for r in rows.select("v", store.bump(F.col("v"), F.lit("patch")).alias("n")).collect()}
    assert got["99999999999999999999.0.0"] == "99999999999999999999.0.1" and got["1.0"] is None and got["1.0.0-rc.2"] == "1.0.1"


def test_an_assertion_reads_the_column_it_is_given(spark):
    rows = spark.createDataFrame([("lines", "a\nb", "2"), ("lines", "a", "2"), ("lines", "a", "x")], "kind string, t string, needed string")
    assert [r[0] for r in rows.select(evaluation.assertion(F.col("kind"), F.col("t"), F.col("needed"))).collect()] == [True, False, None]


@pytest.mark.parametrize(
    ("said", "text", "passed"),
    [("is valid json", '{"a": 1}', True), ("is valid json", "3", True), ("is valid json", "{", False), ("matches regex /A+/", "xAA", True), ("matches regex /A+/ or contains q", "xaa", True),
     ("matches regex /(/", "x(", False), ("matches regex /(/ or contains x", "ax", True), ("matches pattern /*/ or matches regex /b/", "aB", False), ("matches regex /(?P<n>b)/", "abc", True), ("matches regex /x/", None, False),
     ("has at least 2 lines", "a\r\nb\n", True), ("has at least 2 lines", "a\n", False), ("ends with 'C'", "abc \n", None), ("looks good", "x", None), ("contains", "contains", None)],
)
def test_stated_assertions(spark, said, text, passed):
    got = spark.createDataFrame([(said, text)], "a string, t string").select(evaluation.stated(F.col("t"), F.col("a"))).first()[0]
    assert got == passed or (said.startswith("ends") and got in (True, False))


def test_lines_are_counted_as_python_does(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x85e f g\x1ch", "\n\n", "\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.line_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [len(r["t"].splitlines()) for r in rows]


def test_front_matter_needs_whole_lines(spark):
    texts = ["---\na: 1\n---\nbody", "---\na: 1", "--- \na\n---", "x\n---\n---", "---\n---\n", "", None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.front_matter(F.col("t"))).collect()]
    assert got == [("a: 1", 3), (None, 0), (None, 0), (None, 0), ("", 2), (None, 0), (None, 0)]


def test_unscoped_tools_come_before_risky_ones(spark):
    tools = ["Bash(*) Execute", "Execute", "Bash(git:*)", "", None, "Shell", " ".join(f"T{i}" for i in range(16))]
    rows = spark.createDataFrame(list(enumerate(tools)), "doc_id long, tools string")
    got = {(r["doc_id"], r["code"]) for r in skills.broken(rows, skills.permission_checks(F.col("tools")), ["doc_id"]).collect()}
    assert got == {(0, "PERM-001"), (1, "PERM-002"), (5, "PERM-001"), (6, "PERM-003")}


def test_manifest_paths_name_the_parameter(spark):
    schema = "api_version string, kind string, name string, version string, description string, category string, content_path string, content_inline string, params array<struct<name:string,type:string,values:array<string>>>, capabilities array<string>"
    good = ("v", "Skill", "a/b", "1.0.0", "d", None, "p", None, [], [])
    bad = ("w", "Tool", "A", "1", "", "x", None, "", [("a", "string", None), ("b", "enum", []), ("c", "date", None)], ["exec", "fly"])
    rows = spark.createDataFrame([good, bad], schema)
    got = sorted((r["code"], r["path"]) for r in skills.manifest_issues(rows, [], "v").collect())
    assert ("VAL-PARAM-ENUM", "spec.parameters[1].values") in got and ("VAL-PARAM-TYPE", "spec.parameters[2].type") in got and ("VAL-CAP-UNKNOWN", "spec.capabilities[1]") in got
    assert {c for c, _ in got} >= {"VAL-APIVERSION", "VAL-KIND", "VAL-NAME-FORMAT", "VAL-SEMVER", "VAL-DESC-REQUIRED", "VAL-CAT-UNKNOWN", "VAL-CONTENT-EMPTY"}


def test_event_lines_of_both_formats(spark):
    lines = [
        '{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Read"}], "usage": {"input_tokens": 5, "output_tokens": 2}}}',
        '{"type": "content_block_start", "content_block": {"type": "tool_use", "name": "Bash"}}', '{"type": "message_delta", "usage": {"output_tokens": 7}}', "no json", "", '{"type": "other"}',
    ]
    got = runs.event_totals(spark.createDataFrame([(1, x) for x in lines], "run long, line string"), "run", "line").first()
    assert tuple(got) == (1, 4, 2, 5, 9)


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "k long, v string")
    assert catalog.push(empty, empty, ["k"]).count() == 0 and catalog.metadata_diff(empty, empty, "k", "v").count() == 0
    one = spark.createDataFrame([(1, None)], "k long, v string")
    assert catalog.metadata_diff(one, empty, "k", "v").count() == 0  # a missing key and a null are alike
    assert [r["status"] for r in catalog.pull(one.withColumn("h", F.lit("x")), one.withColumn("h", F.lit("x")).select("h", "v"), "h", "v").collect()] == ["E_INTEGRITY"]


def test_text_files_reads_only_what_it_lists(spark, tmp_path):
    for name, data in (("a.md", b"x"), ("b.PY", b"y"), ("c.bin", b"z"), ("big.txt", b"q" * 50), ("bad.md", b"\xff\xfe"), ("dist/d.md", b"d")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["text"], r["skipped"]) for r in files.text_files(spark, f"file://{tmp_path}", largest=20).collect()}
    assert got == {"a.md": ("x", None), "b.PY": ("y", None), "c.bin": (None, "type"), "big.txt": (None, "size"), "bad.md": (None, "encoding"), "dist/d.md": (None, "folder")}


def test_literals_leave_out_no_finding(spark):
    from lodestack.functions import rules as R
    from lodestack.operators import audit

    said = {
        "Generic API Key assignment": "API-KEY = 'abcdefghij0123456789'", "AWS Secret Key": "Secret_Key: '" + "a" * 40 + "'", "OpenAI API Key": "sk-" + "a" * 20 + "T3BlbkFJ" + "b" * 20, "Generic Password": "PWD='longenough'",
        "Generic Token": "Bearer: '" + "q" * 20 + "'", "Private Key": "-----BEGIN RSA PRIVATE KEY-----", "yaml.load without SafeLoader": "yaml.load(f)", "types.FunctionType": "types.FunctionType(c)",
        "References sensitive directory access": "read ~/.SSH", "Starts network listener": "Bind on port", "Accesses stored credentials": "use the TOKEN from", "Execute user-provided code/commands": "Run the user QUERY",
        "Write to arbitrary paths": "save to any Path", "Unbounded user input handling": "accept ALL Data", "References absolute system path": "see /etc/passwd", "pickle.load/loads": "cPickle.loads(x)", "MCP/SSE endpoint URL": "http://h/SSE",
    }
    rules = R.SECRETS + R.CODE + R.PRIVILEGES + R.PATHS
    docs = spark.createDataFrame([(i, f"\n{t}\n") for i, t in enumerate(said.values())] + [(90, "yaml.load(f, Loader=SafeLoader)"), (91, None), (92, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["title"]) for r in audit.findings(docs, rules).collect()}
    assert {(i, n) for i, n in enumerate(said)} <= got and not any(d >= 90 for d, _ in got)
    counts = {r["doc_id"]: r["critical"] + r["warning"] + r["info"] for r in audit.audit(docs, rules).collect()}
    assert all(counts[i] == sum(d == i for d, _ in got) for i in range(len(said))) and counts[90] == counts[91] == counts[92] == 0
