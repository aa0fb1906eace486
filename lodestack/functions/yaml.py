r"""YAML as JSON text: a fold over lines with a stack of indentations, over Arrow batches.

What configuration and front matter use is read: mappings, sequences (also in a mapping's own column), plain, quoted and block
scalars, continued plain scalars, flow sequences and mappings of scalars, comments. Plain scalars are null, booleans
(yes and on too), integers and floats as YAML 1.1 has them; dates, base-60 numbers, infinities and what is no JSON number stay text. Anything
else (anchors, tags, nested flow, quoted scalars over several lines, tabs as indentation, two documents) is invalid, as is
what YAML forbids. A key that is repeated is kept twice here, and the JSON then isn't valid as a variant.

As an expression of Spark the fold took milliseconds for a text, interpreted node by node; a batch takes about a tenth of one.
"""
from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _re(pattern: str) -> re.Pattern:
    """A pattern whose . and $ know all line ends of Unicode, as those of Spark's rlike do."""
    other = "[^\n\r\u0085\u2028\u2029]"
    return re.compile(pattern.replace(".*", f"{other}*").replace(r"\\.", rf"\\{other}").replace("$", "(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z)"), re.ASCII)


_DOUBLE, _SINGLE, _COMMENT = r"""("(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")""", r"'((?:[^']|'')*)'", r"\s*(?:\s#.*)?$"
_INSIDE = r"""((?:[^\[\]{}"'#]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')*)"""
#: A key, double-quoted, single-quoted or plain, and what follows its colon.
KEY = _re(r"""^(?:("(?:[^"\\]|\\.)*")|'((?:[^']|'')*)'|([^\s"'\[\]{}#&*!|>%@`,?:-][^#]*?|[-?:][^\s#][^#]*?))\s*:(?:\s+(.*))?$""")
ITEM = _re(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"']+)\s*(?:,|$)""")
SEQUENCE, MAPPING = _re(rf"^\[{_INSIDE}\]{_COMMENT}"), _re(rf"^\{{{_INSIDE}\}}{_COMMENT}")
DOUBLE, SINGLE, DOUBLE_ON, SINGLE_ON = (_re(f"^{p}{e}") for e in ("$", _COMMENT) for p in (_DOUBLE, _SINGLE))
NULL, TRUE, FALSE = _re(r"^(?:~|null|Null|NULL)?$"), _re(r"^(?:yes|Yes|YES|true|True|TRUE|on|On|ON)$"), _re(r"^(?:no|No|NO|false|False|FALSE|off|Off|OFF)$")
INTEGER, OCTAL, FLOAT = _re(r"^[-+]?(?:0|[1-9][0-9_]*)$"), _re(r"^0[0-7_]+$"), _re(r"^[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+][0-9]+)?$")
BLOCK, NO_SCALAR, NO_PLAIN = _re(r"^[|>][-+]?\s*(?:#.*)?$"), _re(r"^[&*!|>%@`]|: |:$"), _re(r"^[&*!|>%@`,\]}]|^[?-](?:\s|$)|: |:$")
COMMENT, AFTER, BARE, DASH, DASHED = _re(r"(?:^|\s)#.*$"), _re(r"\s#.*$"), _re(r"^(?:#.*)?$"), _re(r"^-(?:\s|$)"), _re(r"^-\s*(.*)$")
BEGIN, END, NO_LINE, BREAK = _re(r"^---\s*(?:#.*)?$"), _re(r"^\.\.\.\s*$"), _re(r"^ *\t|^---"), re.compile(r"\r?\n")


def quoted(text: str) -> str:
    """A JSON string."""
    return json.dumps(text, ensure_ascii=False)


def plain(text: str) -> str:
    """The JSON of a plain scalar. A float has an exponent, so that a variant holds it as a double and 1.0 stays 1.0."""
    if NULL.search(text):
        return "null"
    if TRUE.search(text) or FALSE.search(text):
        return "true" if TRUE.search(text) else "false"
    if INTEGER.search(text):
        return re.sub("[+_]", "", text)
    if OCTAL.search(text):
        return str(int("0" + text.strip().replace("_", ""), 8))
    if FLOAT.search(text):
        number = repr(float(text.replace("_", "")))
        return quoted(text) if "inf" in number else number if "e" in number else number + "E0"
    return quoted(text)


def _unquoted(text: str) -> str:
    return quoted(text.replace("''", "'"))


def _simple(text: str) -> str | None:
    """The JSON of a quoted or plain scalar without a comment; None if it is none."""
    if text.startswith('"'):
        return text.replace("\t", "\\t") if DOUBLE.search(text) else None
    if text.startswith("'"):
        return _unquoted(m[1]) if (m := SINGLE.search(text)) else None
    return None if NO_SCALAR.search(text) else plain(text)


def _pair(text: str) -> str | None:
    m = KEY.search(text)
    value = _simple((m[4] or "").strip(" ")) if m else None
    return None if value is None else f"{_key(m)}:{value}"


def _flow(text: str) -> str | None:
    """The JSON of a quoted scalar or of a flow sequence or mapping of scalars, a comment after it left out; None if it is none."""
    if text[0] in "[{":
        m = (SEQUENCE if text[0] == "[" else MAPPING).search(text)
        if not m:
            return None
        given = [x.strip(" ") for x in (ITEM.findall(m[1]) if text[0] == "[" else m[1].split(","))]
        parts = [(_simple if text[0] == "[" else _pair)(x) for x in given if x]
        return None if None in parts else f"{text[0]}{','.join(parts)}{']' if text[0] == '[' else '}'}"
    m = (DOUBLE_ON if text[0] == '"' else SINGLE_ON).search(text)
    return None if not m else _simple(m[1]) if text[0] == '"' else _unquoted(m[1])


def _key(m: re.Match) -> str:
    return m[1] if m[1] is not None else _unquoted(m[2]) if m[2] is not None else quoted(m[3].strip(" "))


def _folded(text: str) -> str:
    """A line break between two lines that are not indented further is a space, one of several breaks goes."""
    lines = text.split("\n")
    out = [lines[0]]
    for i, (a, b) in enumerate(zip(lines, lines[1:])):
        joins = (a != "" or i == 0) and not (i and a[:1] in (" ", "\t")) and b[:1] not in ("", " ", "\t")
        out += [" " if joins else "\n", b]
    return re.sub(r"(?<=[^\n])\n(\n+)(?=[^\n \t])", r"\1", "".join(out))


class _Fold:
    """The state between two lines: JSON so far; open containers (indentation, sequence or not); the indentation of a key or item without a value
    yet, and whether it is an item; a plain scalar that may go on, and where; a block scalar's header, its parent's and own indentation, and its lines; whether the text is invalid."""

    def __init__(self):
        self.out, self.stack, self.begun, self.bad = [], [], False, False
        self.wait, self.item, self.held, self.held_at = None, False, None, 0
        self.block, self.parent, self.own, self.body = "", 0, -1, []

    def close_block(self) -> None:
        if self.block:
            text = "\n".join("" if x.strip(" ") == "" else x[self.own :] for x in self.body)
            kept = text.rstrip("\n")
            body = _folded(kept) if self.block.startswith(">") else kept
            if kept and "-" not in self.block:
                body += text[len(kept) :] + "\n" if "+" in self.block else "\n"
            self.out.append(quoted(body))
            self.block, self.own, self.body = "", -1, []

    def settle(self, deeper: bool) -> None:
        """A plain scalar ends; a value that never came is null."""
        if self.held is not None:
            self.out.append(plain(self.held))
            self.held = None
        if self.wait is not None and not deeper:
            self.out.append("null")
            self.wait = None

    def pop(self, keep: int) -> None:
        while len(self.stack) > keep:
            self.out.append("]" if self.stack.pop()[1] else "}")

    def open(self, at: int, dash: bool, scalar: bool) -> None:
        """The container of a line's entry: a new one where a value or the text begins, else a comma in the top one."""
        if scalar and self.wait is not None:
            self.wait = None
        elif not scalar and (self.wait is not None or not self.out):
            self.out.append("[" if dash else "{")
            self.stack.append((at, dash))
            self.wait = None
        else:
            self.out.append(",")
            self.bad |= scalar or not self.stack or self.stack[-1] != (at, dash)

    def value(self, value: str, at: int) -> None:
        """A value that stands on its line: the head of a block scalar, a quoted or flow value, or a plain one that may go on."""
        if BLOCK.search(value):
            self.block, self.parent, self.own, self.body = value, at, -1, []
        elif value[:1] in ('"', "'", "[", "{"):
            given = _flow(value)
            self.out.append(given or "")
            self.bad |= given is None
        else:
            self.held, self.held_at = COMMENT.sub("", value).strip(" "), at
            self.bad |= NO_PLAIN.search(self.held) is not None

    def line(self, x: str, i: int) -> None:
        c = x.strip(" ")
        dash = DASH.search(c) is not None
        rest = ((m[1] if (m := DASHED.search(c)) else "") if dash else c)
        key = KEY.search(rest)
        if self.held is not None and not dash and i > self.held_at:
            self.held += " " + AFTER.sub("", c).strip(" ")
            self.bad |= key is not None
            return
        inner = i + max(len(c) - len(rest), 1) if dash else i
        value = (key[4] or "").strip(" ") if key else rest
        self.settle(self.wait is not None and (i > self.wait or (dash and i == self.wait and not self.item)))
        self.pop(sum(at < i or (at == i and (dash or not seq)) for at, seq in self.stack))
        self.open(i, dash, not dash and not key)
        if key:
            if dash:
                self.out.append("{")
                self.stack.append((inner, False))
            self.out += [_key(key), ":"]
        if (key or dash) and BARE.search(value):
            self.wait, self.item = (inner, False) if key else (i, True)
        else:
            self.value(value, inner if key else i if dash else i - 1)

    def read(self, text: str) -> str | None:
        for x in BREAK.split(text):
            blank, i = x.strip(" ") == "", len(x) - len(x.lstrip(" "))
            if self.block and (blank or i > self.parent):
                self.body.append(x)
                if self.own < 0 and not blank:
                    self.own = i
                continue
            self.close_block()
            if blank or x.startswith("#", i) or (not self.begun and BEGIN.search(x)) or END.search(x):
                continue
            if NO_LINE.search(x):
                return None
            self.line(x, i)
            self.begun = True
            if self.bad:
                return None
        self.close_block()
        self.settle(False)
        self.pop(0)
        return "".join(self.out) or "null"


@F.arrow_udf(StringType())
def _json(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _Fold().read(t.decode(errors="replace")) for t in texts.to_pylist()], pa.string())


def yaml_json(text: Column) -> Column:
    """JSON of a YAML text; "null" for one without content, null where it is invalid."""
    return _json(text.cast("binary"))
