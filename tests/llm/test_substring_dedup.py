import random
import re
from collections import defaultdict

import pytest

from lodestack.llm.substring_dedup import dedup_substrings, doubling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    least = defaultdict(lambda: float("inf"))
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - k + 1):
            least[tuple(w[a : a + k])] = min(least[tuple(w[a : a + k])], i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["é", "Wört", " x"]
    passage = rng.choices(v, k=20)
    rows = []
    for i in range(120):
        w = rng.choices(v, k=rng.choice([0, 3, 5, 6, 30, 80]))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(6) :]
        rows.append((i * 7 % 120, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(500, None), (501, ""), (502, "a " * 30_000), (503, rows[3][1]), (504, rows[3][1]), (505, "a " * 40)]


@pytest.mark.parametrize(("window", "start"), [(5, None), (13, None), (13, 4), (6, 6), (18, None)])
def test_matches_brute_force(spark, window, start):
    rows = corpus(window)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string")
    out = dedup_substrings(docs, window, start).collect()
    got = sorted((r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["removed"]), r["kept_text"]) for r in out)
    assert got == brute(rows, window)


def test_edges(spark):
    assert doubling(None, 13) == [7, 13] and doubling(None, 52) == [7, 14, 28, 52] and doubling(None, 5) == [5]
    assert doubling(4, 13) == [4, 8, 13] and doubling(7, 13) == [7, 13] and doubling(1, 1) == [1]
    schema = "doc_id long, text string"
    assert dedup_substrings(spark.createDataFrame([], schema), 5).count() == 0
    same = "a b c d e f g"
    rows = [(None, same), (3, same), (3, same), (1, "z " + same)]
    got = sorted((str(r["doc_id"]), r["kept_text"]) for r in dedup_substrings(spark.createDataFrame(rows, schema), 5).collect())
    assert got == [("1", "z " + same), ("3", ""), ("3", ""), ("None", "")]


def test_different_words_of_equal_polynomial_hashes_stay(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{word} {rest[:30]} x"), (2, f"{other} {rest[:30]} x"), (3, f"{rest} {word} {word}"), (4, f"{rest} {other} {other}")]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["removed"]), r["kept_text"]) for r in out) == brute(rows, 5)
