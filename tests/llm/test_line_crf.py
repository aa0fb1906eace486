import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import line_crf
from lodestack.llm.line_crf import NAMES, line_features, marginals
from lodestack.llm.textarrays import batches


def features(texts):
    xs, lengths, firsts = [], [], [np.zeros(1, np.int64)]
    for _, _, b in batches(pa.array(texts)):
        x, length, first = line_features(b)
        xs.append(x)
        lengths.append(length)
        firsts.append(firsts[-1][-1] + first[1:])
    return np.concatenate(xs), np.concatenate(lengths), np.concatenate(firsts)


def test_features_by_hand():
    texts = ["Hello the World.\nAA!! BB!!\n\nx x x y", None, "", "\n", "é|é\nab ab ab\nab ab ab"]
    x, length, first = features(texts)
    assert np.diff(first).tolist() == [t.count("\n") + 1 if t else 1 for t in texts]
    assert length.tolist() == [len(line.encode()) for t in texts for line in (t or "").split("\n")]
    of = lambda name, i: float(x[i, NAMES.index(name)])
    assert of("upper", 0) == pytest.approx(2 / 16) and of("short_words", 0) == pytest.approx(1 / 3) and of("ends_stop", 0) == 1
    assert of("shout", 1) == pytest.approx(4 / 9) and of("marked_words", 1) == 1
    assert of("empty", 2) == 1 and of("empty", 4) == 1
    assert of("repeated_words", 3) == pytest.approx(0.5) and of("doubled_words", 3) == pytest.approx(0.5)
    assert of("bar", 8) == pytest.approx(1 / 5) and of("wide", 8) == pytest.approx(4 / 5)
    assert of("repeated_line", 9) == 1 and of("repeated_line", 10) == 1 and of("repeated_line", 0) == 0
    assert np.isfinite(x).all()


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 5, 2, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary, pair = rng.normal(size=(first[-1], 2)) * 3, rng.normal(size=(2, 2)) * 2
    one, two = marginals(unary, pair, first)
    at = 0
    for a, z in itertools.pairwise(first.tolist()):
        weight = {}
        for labels in itertools.product((0, 1), repeat=z - a):
            weight[labels] = np.exp(sum(unary[a + i, y] for i, y in enumerate(labels)) + sum(pair[p, q] for p, q in itertools.pairwise(labels)))
        total = sum(weight.values())
        for i in range(z - a):
            assert one[a + i, 1] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)
        for i in range(z - a - 1):
            assert two[at, 1, 0] == pytest.approx(sum(w for y, w in weight.items() if y[i] and not y[i + 1]) / total)
            at += 1


def test_long_documents_stay_finite():
    x, length, first = features(["good line here.\n" * 50_000, "a"])
    one, _ = marginals(np.tile([5.0, -5.0], (len(x), 1)), np.array([[3.0, -3.0], [-3.0, 3.0]]), first)
    assert np.isfinite(one).all()


def corpus(n=700):
    rng = random.Random(6)
    v = ["stone", "the", "of", "river", "walking", "a", "quiet", "house", "and"]
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(v, k=rng.randrange(4, 15))).capitalize() + "." for _ in range(rng.randrange(1, 8))]
        bad = i % 4 == 0
        if bad:
            lines = lines[:1] * (i % 8 == 0) + [" | ".join(rng.choices(v, k=8)) if i % 5 < 3 else " ".join(rng.choices(v, k=8)).upper() + "!!" for _ in range(6)]
        rows.append((i, "\n".join(lines), "x"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(5000, None, "x"), (5001, "", "x"), (None, "The river.", "x"), (5002, "the river " * 100_000, "x")], "doc_id long, text string, score string")
    field = line_crf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r["s"] for r in line_crf.score(docs, field, name="s").collect()}
    assert len(out) == len(rows) + 4 and all(0 <= s <= 1 for s in out.values())
    right = [(out[i] >= 0.3) == (i % 4 != 0) for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.98
    mixed = spark.createDataFrame([(1, "The quiet house and the river.\n" * 8 + "A | b | c | d")], "doc_id long, text string")
    assert line_crf.score(mixed, field, name="s").first()["s"] > 0.5


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (line_crf.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, other))
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope


def test_long_documents_are_learned_from(spark):
    rows, labels = corpus(300)
    good = {i for i, q, _ in labels if q == 1}
    rows = [(i, "\n".join((t.split("\n") * 500)[:500]) if i in good else t, x) for i, t, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    field = line_crf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert field is not None
    out = {r["doc_id"]: r["score"] for r in line_crf.score(docs, field).collect()}
    assert np.mean([out[i] for i in good]) > np.mean([s for i, s in out.items() if i not in good])


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.train(docs, none) is None
    assert line_crf.score(docs, None).first()["score"] == 0.5
    assert line_crf.score(docs.limit(0), None).count() == 0


def test_rows_of_one_id_count_alike_in_any_order(spark):
    rows, labels = corpus(200)
    rows += [(i, f"Another text of {i}.\nTHE | OF", "x") for i, _, _ in labels[:40]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fields = [line_crf.train(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), "doc_id long, text string, x string").repartition(1 + 2 * k), known) for k in range(2)]
    assert np.array_equal(fields[0].weights, fields[1].weights) and fields[0].slope == fields[1].slope
