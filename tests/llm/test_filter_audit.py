import random
import re
from itertools import permutations

import __spark_entry__
import pytest
from lodestack.llm.filter_audit import audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Applies every order of the filters to the rows."""
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        good, toxic = (any(x == i and i is not None and r[k] == 1 for x, *r in labels) for k in (0, 1))
        rows.append((part or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_ever = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_ever[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_ever[order[step - 1]])
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, part int")


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "$5", "a|b", "ünï", "ß", "日本", "x"] + [f"w{i}" for i in range(150)]
    docs = [(i, rng.choice([" ", "\n", "\t\x0b", "\r\f "]).join(rng.choices(words, k=rng.choice([0, 1, 5, 99, 100, 130]))), rng.choice(["en", "fr", "", None])) for i in range(120)]
    docs += [(200 + i, docs[rng.randrange(60)][1], rng.choice(["en", "de"])) for i in range(60)]
    docs += [(None, docs[0][1], "en"), (None, "only here", "en"), (3, docs[3][1], docs[3][2]), (900, None, None), (901, "", "fr"), (902, "A" * 200_000, "en"), (903, " \n", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    out = audit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in out}
    assert len(out) == len(found) and found == brute(docs, labels)


def test_hot_copies_and_empty_tables(spark):
    docs = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(3000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {(r["filter_order"], r["step"]): r for r in audit(frame(spark, docs), none).collect()}
    assert len(out) == 600 and out["EABCD", 1]["removed"] == 1999 and out["AEBCD", 2]["redundant"] == 1999
    assert audit(frame(spark, docs).limit(0), none).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in df.collect())
