"""Cheapest repair of conversations to (system, then) alternating turns of user and assistant, as a min-plus matrix scan.

Wanted are role initials `(s?(ua)+)?`, whose automaton has four states: nothing yet, after s, after u, after a. A turn is
a 4x4 matrix; the element (i, j) is the cheapest way, as (cost, audit), to get from state i to state j by keeping,
re-roling or deleting the turn, multiplied by the closure of insertions after it. The audit spells the edits by their
initials. Matrices multiply with + and concatenation in place of times, and the smaller (cost, audit) in place of plus.
Equally cheap audits of the same turns are never prefixes of each other (the longer one would insert more at the end),
so the order of audits holds under concatenation on either side and the product is associative: runs of turns
are multiplied in tasks, and their matrices by a tree, wherever the turns lie.

Order and limits. Turns are ordered by (turn, role, digest of the text), null turns first. Rows repeated in full are
counted before they are sorted, and sorted ranges may part a conversation anywhere, so a conversation that holds
most rows is spread over all tasks; a task multiplies RUN turns or FAN matrices. What one task must hold is
a conversation's matrix, sixteen audits of a letter a turn, since the audit is one value. The digest of a repaired conversation is
taken of its whole text in order, by one task that streams the rows.

Null fields count as one space, except that a null turn has no place in gaps. A conversation without rows (all dropped)
has zeros and an empty audit; gaps beyond a long are null; an empty table gives an empty result.
"""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestack.llm.workspace import Workspace, attach, estimated_bytes

#: Costs of the edits, by their initials; what an undeleted truncated turn adds.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
#: States: nothing yet, after s, after u, after a. What role can follow each state, and where it leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: Turns that one leaf of the tree multiplies, and matrices that an inner node does.
RUN, FAN = 512, 16
#: Letter of a turn: its role's initial (o: any other), in upper case if truncated, a digit if it must be deleted.
SOUND, CUT, BAD = "suao", "SUAO", "1234"
_ROLE = {letter: role for letters in (SOUND, CUT, BAD) for letter, role in zip(letters, SOUND, strict=True)}
LEGAL = ("su", "ua", "au")

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]  # row by row


def smaller(a: Element, b: Element) -> Element:
    return b if a is None or b is not None and b < a else a


def times(x: Matrix, y: Matrix) -> Matrix:
    out: list[Element] = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost <= best[0]:
                        best = smaller(best, (cost, a[1] + b[1]))
            out.append(best)
    return tuple(out)


UNIT: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def _inserted() -> Matrix:
    """One insertion or none: of a user or an assistant, where the automaton allows it."""
    out = list(UNIT)
    for i, steps in enumerate(STEPS):
        for role, j in steps.items():
            if role != "s":
                out[4 * i + j] = smaller(out[4 * i + j], (COST["I"], "I"))
    return tuple(out)


@functools.cache
def closure() -> Matrix:
    """Any number of insertions: squares until nothing changes."""
    m = _inserted()
    while (square := times(m, m)) != m:
        m = square
    return m


@functools.cache
def turn_matrix(letter: str) -> Matrix:
    """The edits of a turn, then the closure of insertions."""
    more = TRUNCATED if letter in CUT else 0
    out: list[Element] = [(COST["D"], "D") if i == j else None for i in range(4) for j in range(4)]
    if letter not in BAD:
        for i, steps in enumerate(STEPS):
            for role, j in steps.items():
                edits = [(COST["K"] + more, "K")] * (role == _ROLE[letter]) + [(COST["R"] + more, "R")] * (role != "s")
                for e in edits:
                    out[4 * i + j] = smaller(out[4 * i + j], e)
    return times(tuple(out), closure())


@functools.lru_cache(1 << 16)
def _short(letters: str) -> Matrix:
    return functools.reduce(times, map(turn_matrix, letters), UNIT)


def product(letters: str) -> Matrix:
    """The matrix of consecutive turns."""
    if len(letters) <= 6:
        return _short(letters)
    half = (len(letters) // 2 + 5) // 6 * 6
    return times(product(letters[:half]), product(letters[half:]))


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation, whose matrix is m: insertions may come first."""
    best = None
    for k in range(4):
        for j in ACCEPTED:
            a, b = closure()[k], m[4 * k + j]
            if a is not None and b is not None:
                best = smaller(best, (a[0] + b[0], a[1] + b[1]))
    return best


def illegal_pairs(letters: str) -> int:
    roles = "".join(map(_ROLE.get, letters))
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): rows after the damage that crc32 of `conv_id:turn` deals out."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.where(dealt != 0).select(
        F.col("conv_id").alias("conv"), "turn", F.when(dealt == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(dealt == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(turns: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, turn, role, digest, n, blank, duplicate, truncated, letters) of distinct rows; n counts their copies.

    duplicate says that an earlier turn has the role and text; copies of one row are told by n. letters has one for each copy.
    """
    last = F.regexp_extract("text", r"([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*\z", 1)
    keys = turns.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), "copies")
    rows = keys.groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open"))
    of = [F.sha2(F.coalesce(F.col("conv").cast("string"), F.lit("\0")), 256), F.sha2("role", 256), F.hex("digest")]
    rows = ws.save(rows.withColumns({"said": _digest(F.concat(*of)), "_row": F.monotonically_increasing_id()}), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    found = attach(rows, ws.save(again, "said-again"), "said", "_times", rows.count(), "_row")
    duplicate = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)) & F.col("first").isNotNull() & ~F.col("blank")
    found = found.select("conv", "turn", "role", "digest", "n", "blank", duplicate.alias("duplicate"), "open")
    found = found.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    kind = F.when(F.left("role", F.lit(1)).isin(*"sua"), F.instr(F.lit(SOUND), F.left("role", F.lit(1)))).otherwise(4)
    letter = lambda letters: F.substring(F.lit(letters), kind, F.lit(1))
    first = F.when(F.col("blank") | F.col("duplicate"), letter(BAD)).when(F.col("truncated"), letter(CUT)).otherwise(letter(SOUND))
    return found.withColumn("letters", F.concat(first, F.repeat(letter(BAD), (F.col("n") - 1).cast("int")))).drop("open")


#: How turns of a conversation are ordered.
ORDER = ("turn", "role", "digest")

_LONGS, _STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_MATRIX = (
    T.StructType().add("cost", _LONGS).add("audit", _STRINGS).add("illegal", T.LongType()).add("first", T.StringType()).add("last", T.StringType()).add("turns", _LONGS)
)
_SHARES = T.ArrayType(T.StructType().add("part", T.StringType()).add("out", T.LongType()).add("system", T.BooleanType()))
_SETTLED = T.StructType().add("cost", T.LongType()).add("audit", T.StringType()).add("parts", _SHARES)


def _fields(m: Matrix, illegal: int, first: str, last: str, turns: list[int]) -> tuple:
    return [None if e is None else e[0] for e in m], [None if e is None else e[1] for e in m], illegal, first, last, turns


def _matrix(cost, audit) -> Matrix:
    return tuple(None if a is None else (int(c), a) for c, a in zip(cost, audit, strict=True))


@F.pandas_udf(_MATRIX)
def leaf(letters: pd.Series) -> pd.DataFrame:
    """The matrix of a run of turns, its illegal pairs, its first and last role, and its number of turns."""
    rows = [_fields(product(x), illegal_pairs(x), _ROLE[x[0]], _ROLE[x[-1]], [len(x)]) for x in letters]
    return pd.DataFrame(rows, columns=["cost", "audit", "illegal", "first", "last", "turns"])


@F.pandas_udf(_MATRIX)
def node(matrices: pd.Series) -> pd.DataFrame:
    """The same of consecutive runs, in order; turns lists their lengths."""
    rows = []
    for run in matrices:
        m = functools.reduce(times, (_matrix(x["cost"], x["audit"]) for x in run))
        between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(run, run[1:]))
        rows.append(_fields(m, between + sum(x["illegal"] for x in run), run[0]["first"], run[-1]["last"], [int(n) for x in run for n in x["turns"]]))
    return pd.DataFrame(rows, columns=["cost", "audit", "illegal", "first", "last", "turns"])


@F.pandas_udf(_SETTLED)
def settle(cost: pd.Series, audit: pd.Series, turns: pd.Series) -> pd.DataFrame:
    """Cost and audit of a conversation, and of each run its share of the audit.

    out: turns of the result before the share; system: whether the result begins with a system turn. A share ends with the
    insertions after its last turn; those before all turns are in the first.
    """
    rows = []
    for c, a, n in zip(cost, audit, turns, strict=True):
        total, edits = cheapest(_matrix(c, a))
        letters = np.frombuffer(edits.encode(), np.uint8)
        used = np.flatnonzero(letters != ord("I"))  # a letter for each turn
        after = np.append(used[1:], len(letters))[np.cumsum(n) - 1]
        bounds = np.concatenate([[0], after]).tolist()
        kept = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        system = bool(kept[-1] % 2)
        rows.append((total, edits, [{"part": edits[i:j], "out": int(kept[i]), "system": system} for i, j in zip(bounds, bounds[1:])]))
    return pd.DataFrame(rows, columns=["cost", "audit", "parts"])


def _runs(ordered: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, seq, runs, key, cost, ..., turns): matrices of runs of at most RUN rows, numbered by seq in their conversation.

    Rows are numbered over sorted ranges (at), so a run of the same at / RUN is of one range; key is the place of its first row.
    """
    run = ordered.groupBy("conv", F.expr(f"at div {RUN}").alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letters"))), lambda x: x["letters"]), "").alias("letters"),
        F.min_by(F.struct(*ORDER), "at").alias("key"),
    )
    of = Window.partitionBy("conv")
    run = run.withColumns({"seq": F.row_number().over(of.orderBy("run")) - 1, "runs": F.count(F.lit(1)).over(of)})
    return ws.save(run.select("conv", "seq", "runs", "key", leaf("letters").alias("m")).select("conv", "seq", "runs", "key", "m.*"), "runs")


def _tree(runs: DataFrame, ws: Workspace) -> DataFrame:
    """One matrix a conversation: FAN neighbours are multiplied at a time, level by level."""
    fields = ["cost", "audit", "illegal", "first", "last", "turns"]
    done = runs.where("runs = 1").select("conv", *fields)
    level = runs.where("runs > 1").select("conv", "seq", *fields)
    most = level.agg(F.max("seq")).first()[0] or 0
    while most > 0:
        # counted on, a null conversation is a group like any other
        grouped = level.groupBy("conv", F.expr(f"seq div {FAN}").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("run"))
        level = ws.save(grouped.select("conv", "seq", node("run").alias("m")).select("conv", "seq", "m.*"), "level")
        most //= FAN
    return done.unionByName(level.select("conv", *fields))


def _hashed(turns: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(conv, repaired_sha256): rows and, before the first row of each run, its share of the audit, streamed in order."""
    rows = turns.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), F.lit(1).alias("kind"), "text", "copies", F.lit(0).cast("long").alias("out"), F.lit(False).alias("system"))
    marks = parts.select("conv", "key.*", F.lit(0).alias("kind"), F.col("part").alias("text"), F.lit(0).cast("long").alias("copies"), "out", "system")
    order = ["conv", *ORDER, "kind"]
    stream = rows.unionByName(marks).repartition(n, "conv").sortWithinPartitions(*order)
    kind = to_arrow_type(turns.schema["conv"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, edits, out, system, began = None, None, [], 0, False, False

        def say(line: str) -> None:
            nonlocal out, began
            sha.update(("\n" * began + line).encode())
            began, out = True, out + 1

        def role() -> str:
            return "assistant" if (out - system) % 2 else "user"

        def result(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], pa.string())], ["conv", "repaired_sha256"])

        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if sha is None or r["conv"] != conv:
                    if sha is not None:
                        found.append((conv, sha.hexdigest()))
                    conv, sha, edits, began = r["conv"], hashlib.sha256(), [], False
                if r["kind"] == 0:
                    out, system = r["out"], r["system"]
                    edits = re.findall("I*[KRD]I*", r["text"])[::-1]  # of each turn; those before the first turn go with it
                    continue
                for _ in range(r["copies"]):
                    for e in edits.pop():
                        if e == "I":
                            say(f"{role()}:")
                        elif e != "D":
                            say(f"{r['role'] if e == 'K' else role()}:{r['text']}")
            if found:
                yield result(found)
        if sha is not None:
            yield result([(conv, sha.hexdigest())])

    return stream.select("conv", "kind", "role", "text", "copies", "out", "system").mapInArrow(work, f"conv {turns.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame, per_task: int = 32 << 20) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    spark = conversations.sparkSession
    ws = Workspace(spark, "turn-repair")
    turns = damage(conversations)
    size = estimated_bytes(conversations)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 50) // per_task if size < 1 << 60 else 0)
    rows = ws.save(faults(turns, ws), "faults")
    ordered = rows.repartitionByRange(n, "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    ordered = ws.save(ordered.select("conv", *ORDER, "letters", F.monotonically_increasing_id().alias("at")), "ordered")
    runs = _runs(ordered, ws)
    settled = ws.save(_tree(runs, ws).select("conv", "illegal", settle("cost", "audit", "turns").alias("s")).select("conv", "illegal", "s.*"), "settled")
    shares = settled.select("conv", F.posexplode("parts").alias("seq", "p")).select(F.col("conv").alias("_c"), F.col("seq").alias("_s"), "p.*")
    parts = runs.select("conv", "seq", "key").join(shares, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")))
    hashes = _hashed(turns, parts.select("conv", "key", "part", "out", "system"), n)

    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    extra = F.sum(F.when(~F.col("blank") & ~F.col("duplicate"), F.col("n") - 1).otherwise(0))  # copies of a row that is no fault itself
    by_turn = rows.groupBy("conv", "turn").agg(count("blank").alias("blank"), (count("duplicate") + extra).alias("duplicate"), F.count_if("truncated").alias("truncated"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("long")
    counts = by_turn.groupBy("conv").agg(
        F.when(F.count("turn") > 0, gaps).otherwise(0).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated")
    )
    out = conversations.select(F.col("conv_id").alias("_id")).distinct()
    for k, table in enumerate((counts, settled.drop("parts"), hashes)):
        out = out.join(table.withColumnRenamed("conv", f"_c{k}"), F.col("_id").eqNullSafe(F.col(f"_c{k}")), "left").drop(f"_c{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        F.col("_id").alias("conv_id"), F.when(F.col("cost").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"),
        zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
