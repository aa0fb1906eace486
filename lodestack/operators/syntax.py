"""Strict rules on Python files by their syntax: a table of nodes, names resolved by joins over it until nothing is left to resolve."""
from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.sources.tables import new_folder, spread

# Calls that are findings, by name or by where they come from, with code and title.
BUILTINS = {
    "eval": ("SEC-007-AST", "Dangerous builtin: eval()"), "exec": ("SEC-007-AST", "Dangerous builtin: exec()"), "compile": ("SEC-007-AST", "Dangerous builtin: compile()"),
    "__import__": ("SEC-007-AST", "Dynamic import: __import__()"),
}
CALLS = {
    "pickle.loads": ("SEC-006-AST", "Unsafe deserialization: pickle.loads"), "pickle.load": ("SEC-006-AST", "Unsafe deserialization: pickle.load"),
    "marshal.loads": ("SEC-006-AST", "Unsafe deserialization: marshal.loads"), "marshal.load": ("SEC-006-AST", "Unsafe deserialization: marshal.load"),
    "shelve.open": ("SEC-006-AST", "Unsafe deserialization: shelve.open"), "os.system": ("SEC-003-AST", "Subprocess: os.system"), "os.popen": ("SEC-003-AST", "Subprocess: os.popen"),
}
YAML_LOAD = ("SEC-006-AST", "Unsafe deserialization: yaml.load without Loader=")
SHELL = ("SEC-003-AST", "Subprocess with shell=True")
CONCATENATED = ("SEC-008-AST", "Base64 decode of literal-concatenation")

_KEPT = (ast.Call, ast.Name, ast.Attribute, ast.Constant, ast.BinOp, ast.keyword, ast.Import, ast.ImportFrom, ast.alias)
_BARE = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop)  # without children, and never kept
_COLUMNS = [("node", pa.int32()), ("parent", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("name", pa.string()), ("other", pa.string())]
_DDL = "node int, parent int, field string, kind string, line bigint, name string, other string"
ROWS = 20_000


def _described(n: ast.AST) -> tuple[str | None, str | None]:
    """A node's name, and its second name, kind of value, operator or level."""
    match n:
        case ast.Name():
            return n.id, None
        case ast.Attribute():
            return n.attr, None
        case ast.alias():
            return n.name, n.asname
        case ast.keyword():
            return n.arg, None
        case ast.ImportFrom():
            return n.module or "", str(n.level or 0)
        case ast.BinOp():
            return None, type(n.op).__name__
        case ast.Constant():
            return None, "text" if isinstance(n.value, (str, bytes)) else repr(n.value) if isinstance(n.value, bool) else None
    return None, None


def _nodes_of(text: str) -> Iterator[tuple]:
    """Nodes in breadth-first order, numbered; field says which child of its parent a node is, with a number in lists."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    queue, at = [(tree, -1, "")], 0
    while at < len(queue):
        n, parent, field = queue[at]
        if isinstance(n, _KEPT):
            yield at, parent, field, type(n).__name__, getattr(n, "lineno", None), *_described(n)
        for name in n._fields:
            value = getattr(n, name, None)
            if isinstance(value, list):
                queue += [(child, at, f"{name}{k}") for k, child in enumerate(value) if isinstance(child, ast.AST)]
            elif isinstance(value, ast.AST) and not isinstance(value, _BARE):
                queue.append((value, at, name))
        at += 1


def nodes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, node, parent, field, kind, line, name, other): nodes of calls, names, literals and imports. A text that is no Python has none."""
    kind = files.schema[path].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([of.take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[1 + i] for r in rows], t) for i, (_, t) in enumerate(_COLUMNS)]], ["path", *[c for c, _ in _COLUMNS]])

        for batch in batches:
            of, rows = batch.column(0), []
            for i, source in enumerate(batch.column(1).to_pylist()):
                for n in _nodes_of(source or ""):
                    rows.append((i, *n))
                    if len(rows) == ROWS:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return spread(files.select(F.col(path).alias("path"), text)).mapInArrow(work, f"path {kind}, {_DDL}")


def _saved(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "syntax")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _child(tree: DataFrame, prefix: str) -> DataFrame:
    return tree.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("path", "node", "parent", "field", "kind", "name", "other")])


def call_targets(tree: DataFrame) -> DataFrame:
    """(path, call, line, bare, target) of every call: bare is the name that is called, target the dotted name it comes from, by the file's imports.

    An attribute's chain is followed a step in each round of joins, until none is left; a chain that begins with no name has no
    target, nor has a bare name that nothing imports. Of imports that bind one name the last in breadth-first order counts;
    relative ones and stars bind none.
    """
    calls, f = tree.where("kind = 'Call'").select("path", F.col("node").alias("call"), "line"), _child(tree, "_")
    at = calls.join(f, (F.col("path") == F.col("_path")) & (F.col("call") == F.col("_parent")) & (F.col("_field") == "func"))
    step = at.select("path", "call", "line", F.col("_node").alias("at"), F.col("_kind").alias("kind"), F.col("_name").alias("name"), F.lit("").alias("tail"))
    done, step = [], _saved(step)
    while True:
        done.append(step.where("kind = 'Name'"))
        left = step.where("kind = 'Attribute'")
        if left.limit(1).count() == 0:
            break
        deeper = left.join(f, (F.col("path") == F.col("_path")) & (F.col("at") == F.col("_parent")) & (F.col("_field") == "value"))
        step = _saved(deeper.select("path", "call", "line", F.col("_node").alias("at"), F.col("_kind").alias("kind"), F.col("_name").alias("_n"), F.concat(F.lit("."), "name", "tail").alias("tail")).withColumnRenamed("_n", "name"))
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)

    imports = tree.where("kind IN ('Import', 'ImportFrom')").select(F.col("path").alias("_p"), F.col("node").alias("_n"), F.col("kind").alias("_k"), F.col("name").alias("module"), F.col("other").alias("level"))
    bound = tree.where("kind = 'alias'").join(imports, (F.col("path") == F.col("_p")) & (F.col("parent") == F.col("_n")))
    single = (F.col("_k") == "ImportFrom") & (F.col("level") == "0") & (F.col("name") != "*")
    renamed = (F.col("_k") == "Import") & F.col("other").isNotNull()
    full = F.when(single, F.concat_ws(".", F.nullif("module", F.lit("")), "name")).when(renamed, F.col("name"))
    bound = bound.where(single | renamed).groupBy(F.col("path").alias("_p"), F.coalesce("other", "name").alias("_local"), single.alias("_single")).agg(F.max_by(full, "node").alias("_full"))
    out = names.join(bound, (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_local")) & (F.col("_single") == (F.col("tail") == "")), "left")
    target = F.when(F.col("tail") == "", F.col("_full")).otherwise(F.concat(F.coalesce("_full", "name"), "tail"))
    return out.select("path", "call", "line", F.when(F.col("tail") == "", F.col("name")).alias("bare"), target.alias("target"))


def literal_sums(tree: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, call) of calls whose first argument is a sum of text literals only: sums are opened a level in each round of joins."""
    f = _child(tree, "_")
    first = calls.join(f, (F.col("path") == F.col("_path")) & (F.col("call") == F.col("_parent")) & (F.col("_field") == "args0")).where("_kind = 'BinOp' AND _other = 'Add'")
    found = _saved(first.select("path", "call", F.col("_node").alias("at")))
    sums, failed = found.select("path", "call"), None
    while found.limit(1).count():
        # operands that are no literal are not always among the nodes kept, so both sides are counted
        parts = found.join(f, (F.col("path") == F.col("_path")) & (F.col("at") == F.col("_parent")) & F.col("_field").isin("left", "right"), "left")
        parts = _saved(parts.select("path", "call", "at", F.col("_node").alias("part"), ((F.col("_kind") == "Constant") & (F.col("_other") == "text")).alias("text"), ((F.col("_kind") == "BinOp") & (F.col("_other") == "Add")).alias("sum")))
        good = F.coalesce(F.col("text") | F.col("sum"), F.lit(False))
        bad = parts.groupBy("path", "call", "at").agg(F.count_if(good).alias("n")).where("n < 2").select("path", "call")
        failed = bad if failed is None else failed.unionByName(bad)
        found = parts.where("sum").select("path", "call", F.col("part").alias("at"))
    sums = sums.distinct()
    return sums if failed is None else sums.join(failed.distinct(), ["path", "call"], "left_anti")


def strict_findings(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_number, code, severity, title) of Python files: a finding for each call that a rule names, the first that fits."""
    tree = _saved(nodes(files, path, text))
    calls = _saved(call_targets(tree))
    words = tree.where("kind = 'keyword'").select(F.col("path").alias("_wp"), F.col("parent").alias("_wc"), F.col("node").alias("_wn"), F.col("name").alias("_word"))
    values = tree.select(F.col("path").alias("_vp"), F.col("parent").alias("_vc"), F.col("other").alias("_value"), F.col("kind").alias("_vk")).where("_vk = 'Constant'")
    words = words.join(values, (F.col("_wp") == F.col("_vp")) & (F.col("_wn") == F.col("_vc")), "left")
    words = words.groupBy("_wp", "_wc").agg(F.max(F.col("_word") == "Loader").alias("loader"), F.max((F.col("_word") == "shell") & F.coalesce(F.col("_value") == "True", F.lit(False))).alias("shell"))
    sums = literal_sums(tree, calls.where("target = 'base64.b64decode'")).select(F.col("path").alias("_sp"), F.col("call").alias("_sc"), F.lit(True).alias("sum"))
    rows = calls.join(words, (F.col("path") == F.col("_wp")) & (F.col("call") == F.col("_wc")), "left").join(sums, (F.col("path") == F.col("_sp")) & (F.col("call") == F.col("_sc")), "left")
    said = lambda x: F.struct(F.lit(x[0]).alias("code"), F.lit(x[1]).alias("title"))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [(F.col("bare") == k, v) for k, v in BUILTINS.items()] + [(F.col("target") == k, v) for k, v in CALLS.items()]
    rules += [((F.col("target") == "yaml.load") & ~is_("loader"), YAML_LOAD), (F.col("target").startswith("subprocess.") & is_("shell"), SHELL), ((F.col("target") == "base64.b64decode") & is_("sum"), CONCATENATED)]
    found = F.coalesce(*[F.when(c, said(v)) for c, v in rules])
    return rows.select("path", F.col("line").alias("line_number"), found.alias("f")).where("f IS NOT NULL").select("path", "line_number", "f.code", F.lit("WARNING").alias("severity"), "f.title")
