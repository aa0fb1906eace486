import random
import re

from lodestack.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    out = {}
    for i, t, *_ in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            own = words(text)
            for a in range(max(1, len(own) - k + 1) if own else 0):
                win = own[a : a + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


def data():
    rng = random.Random(5)
    v = ["ab", "Cd", "é1", "x", "y", "日本", "q9"]
    items = [(n, " ".join(rng.choices(v, k=rng.choice([1, 2, 4, 6, 9])))) for n in (10, 9, 8, 7)] + [(6, None), (5, "...")]
    docs = [(i, " - ".join(rng.choices(v, k=rng.randrange(30))), "n") for i in range(60)]
    docs += [(100, None, "n"), (101, "", "n"), (102, "ab,cd " * 40_000, "n"), (103, items[3][1].upper(), "n")]
    return docs, items


def check(spark, **more):
    docs, items = data()
    out = decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string, hit string"), spark.createDataFrame(items, "item_id int, text string"), words=4, **more
    )
    got = {r["doc_id"]: (r["n_words"], list(r["hit"]), list(r["items"])) for r in out.collect()}
    assert got == brute(docs, items, 4)


def test_matches_brute_force(spark):
    check(spark)


def test_blocks_of_windows_give_the_same(spark):
    check(spark, block=3)


def test_empty_tables(spark):
    docs, _ = data()
    d, none = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame([], "item_id int, text string")
    assert all(r["hit"] == [] for r in decontaminate(d, none).collect())
    assert decontaminate(d.limit(0), spark.createDataFrame([(1, "a b")], "item_id int, text string")).count() == 0
