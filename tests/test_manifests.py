import json

import pytest
from lodestack.functions.yaml import yaml_json
from lodestack.operators import manifests, skills
from pyspark.sql import functions as F

TEXTS = [
    "apiVersion: v1\nkind: Skill\n\nmetadata:\n  name: org/minimal\n  version: 0.1.0\n  description: \"Only: what # must\"\nspec:\n  content:\n    inline: |\n      # Minimal\n      Just.\n",
    "metadata:\n  authors:\n    - name: Test Author\n      email: t@e.com\n    - name: B\n  tags:\n  - testing\n  - 'it''s'\nspec:\n  parameters:\n    - name: language\n      type: string\n      required: false\n      default: \"python\"\n  capabilities: [read_file, \"x, y\", 3]\n",
    "a: 1\nb: [x, 'y', \"z\", 3]\nc: {k: v, n: 2}\n", "- 1\n- two\n-\n  - x\n- k: v\n  w: z\n-\n", "a:\n- 1\n- b: 2\n  c: 3\nd: e",
    "x: |\n  line one\n    more\n\n  last\n\ny: >-\n  folded text\n  goes on\n\n  para\nz: >\n  a\n  b\n", "d: plain text\n  goes on\n  here\ne: f", "a: b: c", "a: 'x", "a: \"q # no\" # yes\nb: it's # c\nc: http://x.y/z#k",
    "", "# only\n", "k:\n  sub: ~\n  t: yes\n  f: 1.50\n  o: 010\n  v: 1.2.3\nl:", "a: 1\n b: 2", "a:\n    b: 1\n  c: 2", "a: @b", "---\na: 1\n...", "\ta: 1", "a: - b", "'q k': 1\n\"d\\tk\": 2",
    "a:\n  plain\n  words\nb: 1", "a: []\nb: {}\nc: [ ]", "- a\nb: 1", "a: |+\n  x\n\nb: 1", "n: -5\np: +3\nq: 1_000\nr: .5\ns: 1e5\nt: 1.5e+3", "a: x#y\nb: #c\n  d: 1", "desc: >\n  one\n\n\n  two\n   three\n  four\n",
    "a: é\n\"ü\": 日本\r\nb: x\r\n", "a: |\n\n\n  x\n", "a: \"tab\\there\\u00e9\"", "steps:\n  - run: |\n      one\n        two\n    name: x\n  - name: y\nend: 1", "a: \"x\" y", "a:\n  b:\n    c:\n      - d:\n          e: f\n  g: h",
]


def test_yaml_agrees_with_a_library(spark):
    yaml = pytest.importorskip("yaml")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, d string").select("i", yaml_json(F.col("d")).alias("j")).collect()
    for r in rows:
        try:
            want = yaml.safe_load(TEXTS[r["i"]])
        except yaml.YAMLError:
            want = "invalid"
        assert (json.loads(r["j"]) if r["j"] is not None else "invalid") == want, TEXTS[r["i"]]


def test_what_is_not_read_is_invalid(spark):
    odd = ["a: &x 1", "a: *x", "a: !!str 1", "a: [1, [2]]", "b:\n  - - z", "a: 1\n---\nb: 2", "a: \"x\n  y\"", "a: [1,\n  2]", "? a\n: b"]
    rows = spark.createDataFrame([(t,) for t in odd], "d string").select(yaml_json(F.col("d")).alias("j")).collect()
    assert all(r["j"] is None for r in rows)


FILES = [
    ("s/full", "skill.yaml", TEXTS[1].replace("metadata:\n", "governance: {owner: me}\nmetadata:\n  name: org/full\n  version: 1.0\n  description: d\n  license: MIT\n").replace("spec:\n", "spec:\n  content:\n    path: ./docs/../body.txt\n")),
    ("s/full", "SKILL.md", "ignored"), ("s/full", "body.txt", "the body"), ("s/minimal", "skill.yaml", TEXTS[0]), ("s/out", "skill.yaml", "spec:\n  content:\n    path: ../x/SKILL.md"),
    ("s/gone", "skill.yaml", "spec:\n  content:\n    path: a.md"), ("s/empty", "skill.yaml", "# nothing"), ("s/list", "skill.yaml", "- a"), ("s/fields", "skill.yaml", "metadata:\n  authors:\n    - name: A\n      phone: 1"),
    ("s/nofield", "skill.yaml", "spec:\n  dependencies:\n    - name: A"), ("s/nulls", "skill.yaml", "spec:\n  parameters:\n"), ("s/plain", "SKILL.md", "# Plain\n\ntext --- more"), ("s/none", "README.md", "x"),
    ("s/head", "SKILL.md", "---\nname: h\ngov:\n  namespace: org\n  version: 2.0.0\n  authors: [ann, bob]\n  tags: [t]\n---\n\n body \n"), ("s/dashes", "SKILL.md", "---\nname: a---b\ndescription: d\n---\nx"), ("s/bad", "SKILL.md", "---\na: b: c\n---\nx"),
    ("s/null", "SKILL.md", None),
]


def loaded(spark):
    files = spark.createDataFrame([(*f, 1) for f in FILES], "folder string, name string, text string, version int")
    m = manifests.load(files, "v1", "gov").withColumn("json", manifests.to_json())
    return {r["folder"][2:]: r for r in m.withColumn("governance", F.to_json("governance")).collect()}


def test_manifests(spark):
    m = loaded(spark)
    assert {k: r["error"] for k, r in m.items() if r["error"]} == {
        "out": "E_PATH_TRAVERSAL", "gone": "E_NO_CONTENT", "empty": "E_INVALID_YAML", "list": "E_INVALID_YAML", "fields": "E_MANIFEST_FIELDS", "nofield": "E_MANIFEST_FIELDS",
        "nulls": "E_MANIFEST_FIELDS", "none": "E_NO_MANIFEST", "null": "E_NO_MANIFEST"}
    full = m["full"]
    assert (full["name"], full["version"], full["license"], full["tags"], full["content"], full["governance"]) == ("org/full", "1.0", "MIT", ["testing", "it's"], "the body", '{"owner":"me"}')
    assert [tuple(a) for a in full["authors"]] == [("Test Author", "t@e.com"), ("B", None)] and tuple(full["params"][0]) == ("language", "string", False, "python", None, [])
    assert full["capabilities"] == ["read_file", "x, y", "3"] and full["api_version"] == "v1"
    assert (m["minimal"]["name"], m["minimal"]["content"], m["minimal"]["warnings"]) == ("org/minimal", "# Minimal\nJust.\n", [])
    head = m["head"]
    assert (head["name"], head["version"], head["content"], head["warnings"], [a["name"] for a in head["authors"]]) == ("org/h", "2.0.0", "body", ["W_NO_DESCRIPTION"], ["ann", "bob"])
    assert (m["plain"]["name"], m["plain"]["version"], m["plain"]["warnings"], m["plain"]["content"]) == ("plain", "0.0.0", ["W_AUTO_WRAPPED"], "# Plain\n\ntext --- more")
    assert m["bad"]["warnings"] == ["W_AUTO_WRAPPED"] and (m["dashes"]["name"], m["dashes"]["content"]) == ("a", "b\ndescription: d\n---\nx")  # three hyphens end it anywhere
    assert json.loads(full["json"]) == {
        "apiVersion": "v1", "kind": "Skill", "metadata": {"name": "org/full", "version": "1.0", "description": "d", "authors": [{"name": "Test Author", "email": "t@e.com"}, {"name": "B"}], "license": "MIT", "tags": ["testing", "it's"]},
        "spec": {"content": {"path": "./docs/../body.txt"}, "parameters": [{"name": "language", "type": "string", "default": "python"}], "capabilities": ["read_file", "x, y", "3"]}, "governance": {"owner": "me"}}


def test_issues_follow_from_loaded_manifests(spark):
    files = spark.createDataFrame(FILES[:4] + [("s/enum", "skill.yaml", "metadata:\n  name: Bad Name\n  version: x\nspec:\n  parameters:\n    - name: level\n      type: enum\n")], "folder string, name string, text string")
    found = skills.manifest_issues(manifests.load(files, "v1", "gov").where("api_version IS NOT NULL"), ["folder"], "v1").collect()
    assert {(r["folder"], r["code"]) for r in found} >= {("s/enum", "VAL-SEMVER"), ("s/enum", "VAL-PARAM-ENUM"), ("s/enum", "VAL-CONTENT-EMPTY"), ("s/enum", "VAL-DESC-REQUIRED")}


def test_loading_errors(spark):
    rows = [("a", "SKILL.md", "---\nname: x\n---\n"), ("b", "README.md", "x"), ("c", "SKILL.md", None), ("d", "SKILL.md", "name: x"), ("e", "SKILL.md", "---\nname: x\n"), ("f", "SKILL.md", " --- \na: b: c\n---"), ("g", "SKILL.md", "---\n- a\n---\n"), ("h", "SKILL.md", "---\n---\nx")]
    files = spark.createDataFrame(rows, "folder string, name string, text string")
    folders = spark.createDataFrame([(x,) for x in "abcdefghz"], "folder string")
    assert {tuple(r) for r in manifests.loading_errors(folders, files).collect()} == {
        ("b", "STR-002", "no SKILL.md"), ("c", "STR-003", "not readable"), ("d", "STR-004", "no front matter"), ("e", "STR-004", "not closed"), ("f", "STR-004", "no YAML"), ("g", "STR-004", "no mapping"), ("z", "STR-001", "no folder")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "folder string, name string, text string")
    assert manifests.load(none, "v1", "gov").count() == 0 and manifests.loading_errors(none, none).count() == 0
