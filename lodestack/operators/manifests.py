"""Loading of skills: manifests and front matter to variants, with defaults, warnings and errors as columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.yaml import yaml_json
from lodestack.sources.tables import spread

#: Fields that the entries of a manifest's lists may have, and those that they must have.
FIELDS = {"metadata.authors": (["name", "email"], ["name"]), "spec.parameters": (["name", "type", "required", "default", "description", "values"], ["name", "type"]), "spec.dependencies": (["name", "version"], ["name", "version"])}
_PEOPLE, _NEEDS = "array<struct<name: string, email: string>>", "array<struct<name: string, version: string>>"
_PARAMETERS = "array<struct<name: string, type: string, required: boolean, default: string, description: string, values: array<string>>>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def head_and_body(content: Column) -> tuple[Column, Column]:
    """Front matter and body as manifests have them: from three hyphens at the very start to the next three anywhere; nulls without both."""
    end = F.locate("---", content, 4)
    has = content.startswith("---") & (end > 0)
    return F.when(has, _stripped(F.substring(content, F.lit(4), end - 4))), F.when(has, _stripped(F.substring(content, end + 3, F.length(content))))


def _read(rows: DataFrame, text: Column) -> DataFrame:
    """rows with _json: through a generator of one row, so that what is derived from the JSON does not repeat the fold in its plan."""
    return rows.select("*", F.explode(F.array(yaml_json(text))).alias("_json"))


def is_mapping(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _or_empty(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def unexpected_fields(v: Column) -> Column:
    """Whether an entry of a list of people, parameters or dependencies has a field that it may not have or lacks one that it must."""
    wrong = F.lit(False)
    for path, (known, needed) in FIELDS.items():
        entries = _at(v, path, "array<map<string, variant>>")
        keys = lambda e: F.map_keys(e)
        one = lambda e: (F.size(F.array_except(keys(e), F.array(*map(F.lit, known)))) > 0) | (F.size(F.array_except(F.array(*map(F.lit, needed)), keys(e))) > 0)  # noqa: E731, B023
        wrong = wrong | (_at(v, path, "variant").isNotNull() & F.coalesce(entries.isNull() | F.exists(entries, one), F.lit(True)))
    return wrong


def normal_path(path: Column) -> Column:
    """A relative path without . and .. parts that can be resolved."""

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(part.isin("", "."), done).when((part == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def load(files: DataFrame, api_version: str, section: str, folder: str = "folder", name: str = "name", text: str = "text") -> DataFrame:
    """One row a folder of files (folder, name, text; name is the path in the folder): its manifest.

    skill.yaml wins over SKILL.md; the latter is wrapped, with its front matter's name, description and the governance under `section`.
    Columns: folder, source (yaml, markdown or null), api_version, kind, name, version, description, license, category, tags, authors,
    content_path, content_inline, params, capabilities, dependencies, governance (variant), content (what the manifest's path or inline text gives),
    warnings and error (E_NO_MANIFEST, E_INVALID_YAML, E_MANIFEST_FIELDS, E_PATH_TRAVERSAL, E_NO_CONTENT or null). Columns of a manifest that can't be read are null.
    Front matter that is no YAML mapping counts as none. Of files with one name in a folder the largest text counts; a null text is no file.
    """
    of = lambda n: F.max(F.when(F.col(name) == n, F.col(text)))
    rows = spread(files, folder).groupBy(folder).agg(of("skill.yaml").alias("_yaml"), of("SKILL.md").alias("_md")).withColumnRenamed(folder, "folder")
    head, body = head_and_body(F.col("_md"))
    source = F.when(F.col("_yaml").isNotNull(), "yaml").when(F.col("_md").isNotNull(), "markdown")
    rows = rows.select("folder", source.alias("source"), "_md", body.alias("_body"), F.when(source == "yaml", F.col("_yaml")).otherwise(head).alias("_head"))
    rows = _read(rows, F.col("_head"))
    v = F.try_parse_json("_json")
    rows = rows.withColumn("_v", F.when(is_mapping(v) & (F.col("_json") != "{}"), v))
    v, yaml = F.col("_v"), F.col("source") == "yaml"
    error = (
        F.when(F.col("source").isNull(), "E_NO_MANIFEST").when(yaml & v.isNull(), "E_INVALID_YAML").when(yaml & unexpected_fields(v), "E_MANIFEST_FIELDS")
    )
    last = F.substring_index("folder", "/", -1)

    def chosen(of_yaml: Column, of_head: Column, bare: Column) -> Column:
        return F.when(F.col("_error").isNotNull(), None).when(yaml, of_yaml).when(v.isNotNull(), of_head).otherwise(bare)

    people = F.transform(
        _or_empty(_at(v, f"{section}.authors", "array<variant>"), "array<variant>"),
        lambda a: F.when(is_mapping(a), F.struct(F.try_variant_get(a, "$.name", "string").alias("name"), F.try_variant_get(a, "$.email", "string").alias("email")))
        .otherwise(F.struct(F.try_variant_get(a, "$", "string").alias("name"), _none("string").alias("email"))),
    )
    base, space = F.coalesce(F.nullif(_at(v, "name"), F.lit("")), last), F.nullif(_at(v, f"{section}.namespace"), F.lit(""))
    qualified = F.when(space.isNotNull(), F.concat(space, F.lit("/"), base)).otherwise(base)
    strings = lambda path: _or_empty(_at(v, path, "array<string>"), "array<string>")
    empty = F.array().cast("array<string>")
    parameters = F.transform(
        _or_empty(_at(v, "spec.parameters", _PARAMETERS), _PARAMETERS),
        lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), F.coalesce(p["required"], F.lit(False)).alias("required"), p["default"].alias("default"), p["description"].alias("description"), F.coalesce(p["values"], empty).alias("values")),
    )
    fields = {
        "api_version": (F.coalesce(_at(v, "apiVersion"), F.lit(api_version)), F.lit(api_version), F.lit(api_version)),
        "kind": (F.coalesce(_at(v, "kind"), F.lit("Skill")), F.lit("Skill"), F.lit("Skill")),
        "name": (F.coalesce(_at(v, "metadata.name"), F.lit("")), qualified, last),
        "version": (F.coalesce(_at(v, "metadata.version"), F.lit("0.0.0")), F.coalesce(_at(v, f"{section}.version"), F.lit("0.1.0")), F.lit("0.0.0")),
        "description": (F.coalesce(_at(v, "metadata.description"), F.lit("")), F.coalesce(_at(v, "description"), F.lit("")), F.lit("")),
        "license": (_at(v, "metadata.license"), _none("string"), _none("string")),
        "category": (_at(v, "metadata.category"), _at(v, f"{section}.category"), _none("string")),
        "tags": (strings("metadata.tags"), strings(f"{section}.tags"), empty),
        "authors": (_or_empty(_at(v, "metadata.authors", _PEOPLE), _PEOPLE), people, F.array().cast(_PEOPLE)),
        "content_path": (_at(v, "spec.content.path"), _none("string"), _none("string")),
        "content_inline": (_at(v, "spec.content.inline"), F.col("_body"), F.col("_md")),
        "params": (parameters, F.array().cast(_PARAMETERS), F.array().cast(_PARAMETERS)),
        "capabilities": (strings("spec.capabilities"), strings(f"{section}.capabilities"), empty),
        "dependencies": (_or_empty(_at(v, "spec.dependencies", _NEEDS), _NEEDS), F.array().cast(_NEEDS), F.array().cast(_NEEDS)),
        "governance": (_at(v, "governance", "variant"), _none("variant"), _none("variant")),
    }
    rows = rows.withColumn("_error", error)
    out = rows.select("folder", "source", *[chosen(*c).alias(k) for k, c in fields.items()], F.col("_error"), v.isNotNull().alias("_has"))
    warnings = F.array_compact(F.array(
        F.when((F.col("source") == "markdown") & ~F.col("_has"), "W_AUTO_WRAPPED"), F.when((F.col("source") == "markdown") & F.col("_has") & (F.col("description") == ""), "W_NO_DESCRIPTION"),
    ))
    return _with_content(out.withColumn("warnings", warnings), files, folder, name, text).drop("_has")


def _with_content(rows: DataFrame, files: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """rows with content: the inline text, else the file at the path, which must lie in the folder."""
    inline, path = F.nullif(F.col("content_inline"), F.lit("")), F.nullif(F.col("content_path"), F.lit(""))
    wanted = F.when(inline.isNull(), normal_path(path))
    outside = F.coalesce(wanted.isNotNull() & (path.startswith("/") | (F.col("_wanted") == "..") | F.col("_wanted").startswith("../")), F.lit(False))
    there = files.groupBy(F.col(folder).alias("_folder"), F.col(name).alias("_name")).agg(F.max(text).alias("_text"))
    out = rows.withColumn("_wanted", wanted)
    out = out.withColumn("_outside", outside).join(there, (F.col("folder") == F.col("_folder")) & (F.col("_wanted") == F.col("_name")), "left")
    content = F.when(F.col("_error").isNotNull() | F.col("_outside"), None).when(inline.isNotNull(), inline).when(path.isNotNull(), F.col("_text")).otherwise("")
    error = F.coalesce("_error", F.when(F.col("_outside"), "E_PATH_TRAVERSAL"), F.when(content.isNull(), "E_NO_CONTENT"))
    return out.select(*[c for c in rows.columns if c not in ("_error", "warnings")], content.alias("content"), "warnings", error.alias("error"))


def to_json() -> Column:
    """A loaded manifest as JSON, without the fields that are empty."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    people = F.transform("authors", lambda a: F.struct(a["name"].alias("name"), F.nullif(a["email"], F.lit("")).alias("email")))
    parameters = F.transform("params", lambda p: F.struct(
        p["name"].alias("name"), p["type"].alias("type"), F.when(p["required"], True).alias("required"), F.nullif(p["default"], F.lit("")).alias("default"),
        F.nullif(p["description"], F.lit("")).alias("description"), F.when(F.size(p["values"]) > 0, p["values"]).alias("values")))
    metadata = F.struct("name", "version", "description", F.when(F.size("authors") > 0, people).alias("authors"), text("license").alias("license"), filled("tags").alias("tags"), text("category").alias("category"))
    spec = F.struct(
        F.struct(text("content_path").alias("path"), text("content_inline").alias("inline")).alias("content"), F.when(F.size("params") > 0, parameters).alias("parameters"),
        F.col("capabilities"), filled("dependencies").alias("dependencies"))
    governed = F.when(F.to_json("governance") != "{}", F.col("governance"))
    return F.when(F.col("error").isNull(), F.to_json(F.struct(F.col("api_version").alias("apiVersion"), "kind", metadata.alias("metadata"), spec.alias("spec"), governed.alias("governance"))))


def loading_errors(folders: DataFrame, files: DataFrame, folder: str = "folder", name: str = "name", text: str = "text") -> DataFrame:
    """(folder, code, reason) of skills that can't be audited further: STR-001 no such folder, STR-002 no SKILL.md, STR-003 not readable
    (a null text), STR-004 without front matter between two lines of three hyphens that is empty or a YAML mapping."""
    of = F.col(name) == "SKILL.md"
    by = files.groupBy(F.col(folder).alias("_folder")).agg(F.max(of).alias("_has"), F.max(F.when(of, F.col(text))).alias("_text"))
    rows = folders.select(F.col(folder).alias("folder")).distinct().join(by, F.col("folder") == F.col("_folder"), "left")
    lines = F.split("_text", "\n", -1)
    opened = F.trim(F.get(lines, F.lit(0))) == "---"
    rest = F.slice(lines, F.lit(2), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: _stripped(x) == "---"), True)
    head = F.array_join(F.slice(rest, F.lit(1), F.greatest(end.cast("int") - 1, F.lit(0))), "\n")
    rows = _read(rows.withColumns({"_open": _stripped(F.get(lines, F.lit(0))) == "---", "_end": end}), F.when(opened & (end > 0), head))
    v = F.try_parse_json("_json")
    empty = F.col("_json").isin("null", "false", "0", '""', "[]", "{}")
    found = (
        F.when(F.col("_folder").isNull(), F.struct(F.lit("STR-001").alias("code"), F.lit("no folder").alias("reason")))
        .when(~F.col("_has"), F.struct(F.lit("STR-002").alias("code"), F.lit("no SKILL.md").alias("reason")))
        .when(F.col("_text").isNull(), F.struct(F.lit("STR-003").alias("code"), F.lit("not readable").alias("reason")))
        .when(~F.col("_open"), F.struct(F.lit("STR-004").alias("code"), F.lit("no front matter").alias("reason")))
        .when(F.col("_end") == 0, F.struct(F.lit("STR-004").alias("code"), F.lit("not closed").alias("reason")))
        .when(v.isNull(), F.struct(F.lit("STR-004").alias("code"), F.lit("no YAML").alias("reason")))
        .when(~is_mapping(v) & ~empty, F.struct(F.lit("STR-004").alias("code"), F.lit("no mapping").alias("reason")))
    )
    return rows.select("folder", found.alias("_f")).where("_f IS NOT NULL").select("folder", "_f.code", "_f.reason")
