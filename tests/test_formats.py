import pytest
from lodestack.operators.formats import STYLES, translate

OWN = ["model", "hooks"]
HEADS = [
    "name: x\ndescription: a b\nmodel: m\npaths:\n  - a/*.py\n  - b\nn: 3\nflag: true\n", "description: d\ndisable-model-invocation: true\npaths: src/**\n", "paths: [x]\ndisable-model-invocation: false\nz: ~\n",
    "disable-model-invocation: true\n", "zeta: 1\nalpha: two\ntags: [p, q]\n", "trigger: own\npaths: a\n", "globs: mine\nname: other\n", "alwaysApply: keep\npaths: []\n",
]


def said(v):
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else v


def emit(fm):
    lines = ["---"]
    for k, v in fm.items():
        lines += [f"{k}:", *[f'  - "{x}"' for x in v]] if isinstance(v, list) else [f"{k}: {said(v)}"]
    return "\n".join([*lines, "---"])


def expected(name, fm, body, style):
    """The rules in plain Python, over a dictionary that keeps its order."""
    as_list = lambda v: v if isinstance(v, list) else [v]
    joined = lambda v: '"' + ",".join(as_list(v)) + '"'
    if style == "paths":
        return f"{emit({'applyTo': joined(fm['paths'])})}\n\n{body}\n" if fm.get("paths") else f"{body}\n"
    out = {"name": name} if style == "inclusion" else {}
    for k, v in fm.items():
        if style != "plain" and k in OWN:
            continue
        if style == "switch" and k == "paths":
            out["globs"] = as_list(v)
        elif style == "switch" and k == "disable-model-invocation":
            out["alwaysApply"] = False
        elif style == "trigger" and k == "paths":
            out |= {"trigger": "glob", "globs": as_list(v)}
        elif style == "trigger" and k == "disable-model-invocation":
            out["trigger"] = "manual" if v else "model_decision"
        elif style == "inclusion" and k == "paths":
            out |= {"inclusion": "fileMatch", "fileMatchPattern": joined(v)}
        elif style == "inclusion" and k == "disable-model-invocation":
            out["inclusion"] = "manual" if v else "auto"
        else:
            out[k] = v
    if style == "switch" and "alwaysApply" not in out:
        out["alwaysApply"] = "globs" not in out
    for s, default in (("trigger", "always_on"), ("inclusion", "always")):
        if style == s:
            out.setdefault(s, default)
    return f"{emit(out)}\n\n{body}\n"


def test_styles(spark):
    yaml = pytest.importorskip("yaml")
    rows = [(f"n{i}", f"---\n{h}---\n\nthe body\nof it") for i, h in enumerate(HEADS)] + [("none", "no head"), ("null", None), ("bad", "---\na: b: c\n---\nx"), ("empty", "")]
    out = translate(spark.createDataFrame([(*r, "s") for r in rows], "name string, text string, style2 string"), "name", "text", OWN).collect()
    assert len(out) == len(rows) * len(STYLES)
    for r in out:
        if r["name"].startswith("n") and r["name"][1:].isdigit():
            want = expected(r["name"], yaml.safe_load(HEADS[int(r["name"][1:])]), "the body\nof it", r["style"])
        else:
            want = expected(r["name"], {}, r["text"] or "", r["style"])
        assert r["translated"] == want, (r["name"], r["style"])


def test_one_small_file_is_dealt_to_many_tasks(spark):
    texts = spark.createDataFrame([(f"n{i}", HEADS[0], "s") for i in range(40)], "name string, text string, s string").coalesce(1)
    out = translate(texts, "name", "text", OWN)
    assert out.rdd.getNumPartitions() >= 4 and out.count() == 40 * len(STYLES)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000  # parsed once, not once a field and style
