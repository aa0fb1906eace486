import hashlib
import random
import re
import zlib
from itertools import product as cartesian

import __spark_entry__
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestack.llm import turn_repair
from lodestack.llm.turn_repair import BAD, CUT, SOUND, cheapest, product, repair, times

LETTERS = SOUND + CUT + BAD
SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def exhaustive(letters):
    """The cheapest (cost, audit) among all edits with up to two insertions in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for before in cartesian(gaps, repeat=len(letters) + 1):
        for edits in cartesian("KDua", repeat=len(letters)):
            roles, audit, cost = before[0], "I" * len(before[0]), 2 * len(before[0])
            for x, e, gap in zip(letters, edits, before[1:], strict=True):
                if x in BAD and e != "D":
                    break
                if e == "D":
                    audit, cost = audit + "D", cost + 3
                else:
                    role = "suao"[(SOUND + CUT).index(x) % 4] if e == "K" else e
                    roles, audit, cost = roles + role, audit + ("K" if e == "K" else "R"), cost + 2 * (e != "K") + (x in CUT)
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


@pytest.mark.parametrize("length", [1, 2])
def test_short_conversations_exhaustively(length):
    for letters in map("".join, cartesian(LETTERS, repeat=length)):
        assert cheapest(product(letters)) == exhaustive(letters), letters


def test_three_turns_exhaustively():
    rng = random.Random(1)
    for letters in ("".join(rng.choices(LETTERS, k=3)) for _ in range(12)):
        assert cheapest(product(letters)) == exhaustive(letters), letters


def by_turn(letters):
    """The same by a dynamic programme over whole audits of each state."""
    def inserted(best):
        for _ in range(3):
            for s, role, to in ((0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)):
                if best[s] is not None:
                    new = (best[s][0] + 2, best[s][1] + "I")
                    best[to] = min(x for x in (best[to], new) if x is not None)
        return best

    best = inserted([(0, ""), None, None, None])
    for x in letters:
        options = [[], [], [], []]
        for s in range(4):
            if best[s] is None:
                continue
            c, a = best[s]
            options[s].append((c + 3, a + "D"))
            if x in BAD:
                continue
            role, more = "suao"[(SOUND + CUT).index(x) % 4], x in CUT
            for r, frm, to in (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("a", 2, 3), ("u", 3, 2)):
                if frm == s:
                    if r == role:
                        options[to].append((c + more, a + "K"))
                    if r != "s":
                        options[to].append((c + 2 + more, a + "R"))
        best = inserted([min(o, default=None) for o in options])
    return min(x for x in (best[0], best[3]) if x is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, min_size=1, max_size=60))
def test_long_conversations_by_dynamic_programming(letters):
    assert cheapest(product(letters)) == by_turn(letters)


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, min_size=1, max_size=12), st.text(LETTERS, min_size=1, max_size=12), st.text(LETTERS, min_size=1, max_size=12))
def test_products_associate(a, b, c):
    x, y, z = map(product, (a, b, c))
    assert times(times(x, y), z) == times(x, times(y, z)) == product(a + b + c)


def brute(rows):
    """What repair gives, from rows (conv, turn, role, text) in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            name = lambda v: " " if v is None else str(v)
            h = zlib.crc32(f"{name(c)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            turns += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        letters, seen, n = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            kind = "sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letters += (SOUND if not fault else CUT if fault == "truncated" else BAD)[kind]
        known = {t[0] for t in turns if t[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        firsts = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit = by_turn(letters) if letters else (0, "")
        lines, rest = [], list(turns)
        system = sum(e != "D" for e in audit) % 2
        for e in audit:
            role = "assistant" if (len(lines) - system) % 2 else "user"
            if e == "I":
                lines.append(f"{role}:")
                continue
            _, own, text = rest.pop(0)
            if e != "D":
                lines.append(f"{own if e == 'K' else role}:{text}")
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(spark, rows):
    df = repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    out = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return out


def some_rows(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes. ", "no", "", " \n", "Why?\t", "a b c!", "...", "ü", None, "é.\x0b", "x " * 3000]
    roles = ["user", "assistant", "system", "tool", "", None, "sam", "User"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    return [
        (c, rng.choice([t, t, t, t, None, t * 3]), rng.choices(roles, weights)[0], rng.choice([rng.choice(texts), f"Answer {t}."]))
        for c in convs for t in range(rng.randint(1, turns))
    ]


def test_matches_brute_force(spark):
    rows = some_rows(7, [*range(60), None], 12)
    rows += rows[:40] + [(1000, 5, None, None)] + [(2000 + i, i, "user", "alone.") for i in range(40)]
    assert made(spark, rows) == brute(rows)


def test_long_conversation_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "RUN", 16)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    rows = some_rows(9, [1], 2) + [(5, t, random.Random(t).choice(["user", "assistant", "system"]), f"turn {t % 50}{'.' * (t % 4)}") for t in range(900)] + some_rows(4, [9, None], 90)
    assert made(spark, rows) == brute(rows)


def test_a_third_of_rows_repeated_in_full(spark):
    rows = [(1, None, "user", "Same.")] * 2000 + some_rows(3, range(10, 40), 6)
    assert made(spark, rows) == brute(rows)


def test_empty_table_and_extreme_turns(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 3, "user", "c.")]
    out = made(spark, rows)
    assert out[1][0] is None or out[1][0] == 0  # more than a long holds, unless the damage dropped one of the turns
    assert out[2] == brute(rows)[2]


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = __spark_entry__.queries()["op13_turn_repair"](spark, sf)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()['op13_turn_repair']})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in df.collect())
