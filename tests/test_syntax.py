import pytest
from lodestack.operators.syntax import nodes, strict_findings

FILES = {
    "alias.py": ("from pickle import loads as L\nimport pickle as p\nimport xml.etree.ElementTree as ET\nL(x)\np.loads(\n  y)\nET.parse(x)\np.q.loads(x)\nloads(x)\n", {(4, "SEC-006-AST"), (5, "SEC-006-AST")}),
    "builtin.py": ("eval('1')\nx = [exec(y) for y in z]\ndef f():\n    return compile(a, b, c)(__import__('os'))\nobj.eval(1)\n", {(1, "SEC-007-AST"), (2, "SEC-007-AST"), (4, "SEC-007-AST")}),
    "yaml.py": ("import yaml\nyaml.load(s)\nyaml.load(s, Loader=L)\nyaml.safe_load(s)\nfrom yaml import load\nload(s)\nload(s, Loader=x)\n", {(2, "SEC-006-AST"), (6, "SEC-006-AST")}),
    "shell.py": ("import subprocess as sp\nsp.run(a, shell=True)\nsp.run(a, shell=False)\nsp.run(a, shell=x)\nsubprocess.Popen(a,\n  env=b, shell=True)\nrun(a, shell=True)\n", {(2, "SEC-003-AST"), (5, "SEC-003-AST")}),
    "b64.py": ("from base64 import b64decode as d\nimport base64\nd('A' + 'B')\nd(b'A' + b'B' + b'C')\nd('A' + x)\nd('A' 'B')\nbase64.b64decode(('A' + 'B') + ('C' + f()))\nd('A' - 'B')\nd(('A' + 'B') + ('C' + 'D'))\nd()\nd('A' + 1)\nd('A' + f'{x}')\n", {(3, "SEC-008-AST"), (4, "SEC-008-AST"), (9, "SEC-008-AST")}),
    "deep.py": ("a.b.c.d.e.f(x)\nos.system('ls')\nf().g.h(x)\n'x'.join(y)\nimport os.path\nos.popen(q).read()\n", {(2, "SEC-003-AST"), (6, "SEC-003-AST")}),
    "relative.py": ("from .pickle import loads\nfrom pickle import *\nloads(x)\n", set()),
    "last.py": ("from pickle import loads as f\ndef g():\n    from json import loads as f\nf(x)\n", set()),
    "shadow.py": ("import pickle as os\nos.system(x)\nos.loads(x)\n", {(3, "SEC-006-AST")}),
    "broken.py": ("def (:\n", set()), "nul.py": ("a\0b", set()), "empty.py": ("", set()), "null.py": (None, set()),
}


def test_rules(spark):
    df = spark.createDataFrame([(p, t, "x", 1) for p, (t, _) in FILES.items()], "path string, text string, node string, kind int")
    got = {}
    for r in strict_findings(df).collect():
        got.setdefault(r["path"], []).append((r["line_number"], r["code"]))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(want) for p, (_, want) in FILES.items() if want} | {"builtin.py": [(1, "SEC-007-AST"), (2, "SEC-007-AST"), (4, "SEC-007-AST"), (4, "SEC-007-AST")]}


def test_repeated_paths_do_not_multiply_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "eval(x)"), ("b", "eval(x)\n" * 50)], "path string, text string")
    assert strict_findings(df).count() == 51
    assert strict_findings(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [9])
def test_long_chains(spark, n):
    text = f"import pickle as p\np{'.x' * n}.loads(y)\nb64decode({' + '.join(['1'] * n)})\nfrom base64 import b64decode\nb64decode({' + '.join([chr(34) + 'A' + chr(34)] * 12)})\n"
    rows = strict_findings(spark.createDataFrame([("a", text)], "path string, text string")).collect()
    assert [(r["line_number"], r["code"]) for r in rows] == [(5, "SEC-008-AST")]


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(str(i), "f(x)") for i in range(40)], "path string, text string").coalesce(1)
    tree = nodes(files)
    assert tree.rdd.getNumPartitions() >= 4 and tree.select("path").distinct().count() == 40
