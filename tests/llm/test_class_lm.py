import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import class_lm
from lodestack.llm.class_lm import exchange_pass, score_held_out, train
from lodestack.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def corpus(n=400):
    """Two languages of three word classes each, so that the class before tells the class."""
    rng = random.Random(4)
    kinds = [[f"{k}{chr(97 + i)}{x}" for i in range(12)] for k, x in itertools.product("pq", "xyz")]
    rows = []
    for i in range(n):
        own = kinds[:3] if rng.random() < 0.5 else kinds[3:]
        text = [rng.choice(own[t % 3]) for t in range(rng.randrange(60))]
        rows.append((i, " ".join(text + ["Rare" + str(i)] * (i % 5 == 0)).upper() if i % 7 else "\n".join(text), 1))
    return [*rows, (9000, None, 1), (9001, "", 1), (9002, "ß word " * 30_000, 1), (None, "pax", 1), (None, "pax", 1), (9003, "unseen-" + "x" * 3000, 1)]


@pytest.mark.parametrize(("units", "head"), [(16_384, 262_144), (20, 20)])
def test_counts_and_base_match_brute_force_and_classes_help(spark, units, head):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = [r.asDict() for r in score_held_out(docs, classes=8, units=units, head=head).collect()]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    texts = {i: t for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        w = words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(map(base, w)), rel_tol=1e-9, abs_tol=1e-9)
    new = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new) + 0.2 * sum(r["n_tokens"] for r in new)


def test_probabilities_add_up(spark):
    """P(. | v) over all known words, END and an unknown word of each class is 1; scores are their products."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(60)[:60]], "doc_id long, text string")
    ws = Workspace(spark, "t")
    m = train(docs, ws, classes=4, units=10, head=10)
    known = sorted({w for (_, t, _) in corpus(60)[:60] for w in words(t) if w})
    one = spark.createDataFrame([(i, w) for i, w in enumerate(known)] + [(-1, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in class_lm.score(one, m, ws).collect()}
    # score(w) = P(w | END) P(END | w); divide by the last factor, which a class alone decides
    end = 10 ** s[-1]
    unknown = 10 ** (m.transitions[0] + np.log10(0.1) - m.words)
    import pyarrow as pa
    from lodestack.llm.textarrays import batches

    ((_, _, b),) = batches(pa.array(known))
    c = m.classes[class_lm._units_of(b.hashes(), class_lm.endings(b), class_lm.Lookup(m.unit_words))]
    end_after = end / 10 ** m.transitions[0, 0] * 10 ** m.transitions[c, 0]
    first = np.array([10 ** s[i] for i in range(len(known))]) / end_after
    assert math.isclose(first.sum() + end + unknown.sum(), 1, rel_tol=1e-6)


def test_exchange_never_lowers_the_likelihood_of_fixed_contexts():
    rng = np.random.default_rng(1)
    k, units = 4, 30
    pairs = rng.integers(0, 20, (units, units)) * (rng.random((units, units)) < 0.3)
    of = rng.integers(0, k, units)

    def tables(of):
        one = np.eye(k, dtype=int)[of]
        return pairs.T @ one, pairs @ one, one.T @ pairs @ one

    before = class_lm._likelihood(tables(of)[2].astype(float))
    for u in range(units):
        left, right, _ = tables(of)
        of2 = exchange_pass(left, right, np.diagonal(pairs), of, np.array([u]))
        best = max(range(k), key=lambda b: class_lm._likelihood(tables(np.where(np.arange(units) == u, b, of))[2].astype(float)))
        want = class_lm._likelihood(tables(np.where(np.arange(units) == u, best, of))[2].astype(float))
        assert math.isclose(class_lm._likelihood(tables(of2)[2].astype(float)), want, rel_tol=1e-12)
        of = of2
    assert class_lm._likelihood(tables(of)[2].astype(float)) > before


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert score_held_out(spark.createDataFrame([], schema)).count() == 0
    rows = score_held_out(spark.createDataFrame([(None, "only held out")], schema)).collect()
    assert rows[0]["train_tokens"] == 0 and rows[0]["n_known"] == 0
