import random
import re

import numpy as np
import pytest

from lodestack.llm import jaccard_join
from lodestack.llm.jaccard_join import PROBE, WHOLE, bands, choose_schemas, extra, lacking, segment_keys, similarity_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i, s in sets.items() if s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 8, 15, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w).upper() if n % 3 else "\n".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, rows[0][1])]
    return rows


@pytest.mark.parametrize(("seed", "k", "num", "den", "levels", "gather"), [(1, 3, 90, 100, 8, 2), (2, 5, 8, 10, 8, 2), (3, 3, 7, 10, 0, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, k, num, den, levels, gather):
    monkeypatch.setattr(jaccard_join, "PAIR_COST", 1e9 if seed == 2 else 20.0)  # many deletions
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    monkeypatch.setattr(jaccard_join, "GATHER", gather)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_classes(docs, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


@pytest.mark.parametrize("levels", [0, 1, 8])
def test_every_linked_pair_meets(monkeypatch, levels):
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    rng = np.random.default_rng(3)
    linked = 0
    for num, den in ((8, 10), (9, 10), (1, 2)):
        sizes = bands(num, den, 800)
        for cost in (0.0, 20.0, 1e12):
            monkeypatch.setattr(jaccard_join, "PAIR_COST", cost)
            schemas = choose_schemas(sizes, num, den)
            for _ in range(300):
                n = int(rng.choice([1, 2, 3, 5, 8, 10, 12, int(rng.integers(1, 300))]))
                a = rng.integers(0, 2**63, n, np.uint64)
                more = rng.integers(0, 2**63, int(n * den / num) - n + 1, np.uint64)
                cut = int(rng.integers(0, n // 5 + 1))
                s, t = np.unique(a), np.unique(np.concatenate([a[cut:], more[: int(rng.integers(0, len(more) + 1))]]))
                both = len(np.intersect1d(s, t))
                if not len(t) or den * both < num * (len(s) + len(t) - both):
                    continue
                linked += 1
                at = []
                for x in (s, t):
                    band = next(b for b, (_, hi) in enumerate(sizes) if len(x) <= hi)
                    of = [segment_keys(x, b, *schemas[b]) for b in {band, max(0, band - 1)}]
                    often = np.sort(rng.permutation(of[0][0])[: len(of[0][0]) // 2])  # each set has its own view of what is hot
                    of = [segment_keys(x, b, *schemas[b], (often, np.full(len(often), 99))) for b in {band, max(0, band - 1)}]
                    at.append({k: f for keys, flags in of for k, f in zip(keys.tolist(), flags.tolist(), strict=True)})
                assert any(at[0][k] | at[1][k] == WHOLE | PROBE for k in at[0].keys() & at[1].keys())
    assert linked > 1000


def test_no_set_looks_up_an_empty_subset():
    rng = np.random.default_rng(4)
    sizes = bands(8, 10, 400)
    schemas = choose_schemas(sizes, 8, 10)
    seen = {}
    for i in range(2000):
        s = np.unique(rng.integers(0, 2**63, int(rng.integers(40, 60)), np.uint64))
        band = next(b for b, (_, hi) in enumerate(sizes) if len(s) <= hi)
        for k in set(segment_keys(s, band, *schemas[band])[0].tolist()):
            seen.setdefault(k, set()).add(i)
    assert max(map(len, seen.values())) == 1  # sets that share nothing share no key


def test_sketches_differ_in_no_more_places_than_sets_in_elements():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, cut, more = (int(rng.integers(0, x)) for x in (2000, 50, 50))
        s = rng.integers(0, 2**63, n, np.uint64)
        t = np.concatenate([s[cut:], rng.integers(0, 2**63, more, np.uint64)])
        a, b = (jaccard_join.parity_sketch(np.unique(x)).view(np.uint64) for x in (s, t))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(s, t))


def test_large_near_copy_group_and_empty_table(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"u{i}"] + base[50:])) for i in range(150)] + [(900, None)]
    got = {r["doc_id"]: r["component_id"] for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10).collect()}
    assert got == {**dict.fromkeys(range(150), 0), 900: 900}
    assert similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("num", "den"), [(8, 10), (90, 100), (1, 2), (1, 3), (1, 1)])
def test_linked_sets_share_the_necessary_elements(num, den):
    rng = random.Random(num)
    linked = 0
    for _ in range(3000):
        n = rng.choice([1, 2, 3, 5, 9, 10, 11, 30, 90])
        both = rng.randint(max(1, n * num // den - 1), n)
        a, b, c = range(both), range(1000, 1000 + n - both), range(2000, 2000 + rng.randint(0, n))
        if den * both < num * (both + len(b) + len(c)):
            continue
        linked += 1
        order = rng.sample(range(3000), 3000)
        x, y = (sorted((*a, *own), key=order.__getitem__) for own in (b, c))
        sent = [set(s[: lacking(len(s), num, den) + extra(len(s), num, den)]) for s in (x, y)]
        for s in (x, y):
            assert len(sent[0] & sent[1]) >= extra(-(-len(s) * num // den), num, den)
    assert linked > 300


def twins(n):
    """Two different words of equal length whose polynomial hashes modulo 2^64 are equal for every odd base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_sets_of_different_words_are_different(spark):
    x, y = twins(2048)
    rows = [(1, x), (2, y), (3, f"one {x} two three"), (4, f"one {y} two three")]
    got = {r["doc_id"]: r["component_id"] for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_of_one_id_and_null_ids_keep_their_links(spark):
    base = {c: [f"{c}{i}" for i in range(40)] for c in "AB"}
    near = lambda c, n: " ".join(base[c][:n] + ["x"] + base[c][n + 1 :])
    rows = [(7, " ".join(base["A"])), (7, " ".join(base["B"])), (8, near("A", 0)), (9, near("B", 0)), (9, near("B", 0))]
    got = sorted((r["doc_id"], r["component_id"]) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10).collect())
    assert got == [(7, 7), (7, 7), (8, 7), (9, 7), (9, 7)]
    chain = [f"c{i}" for i in range(60)]
    step = lambda n: " ".join(chain[n : n + 50])
    for middle in (4, None):  # 5 and 6 link with it, not with each other
        rows = [(5, step(0)), (middle, step(4)), (6, step(8)), (None, "alone"), (None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r["doc_id"], r["component_id"]) for r in similarity_classes(docs, 3, 8, 10).collect()]
        least = middle or 5
        assert sorted(got, key=str) == sorted([(5, least), (middle, least), (6, least), (None, None), (None, None)], key=str)


def test_columns_may_have_any_name(spark):
    rows = [(1, "a b c d e", 1, 2, 3, 4), (2, "a b c d e", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, _id long, component long, sid long")
    assert [r["component_id"] for r in similarity_classes(docs).collect()] == [1, 1]


def test_counts_of_a_set_are_packed_and_added_once():
    import numpy as np
    import pandas as pd
    from lodestack.llm import exchange, jaccard_join as j

    rng = np.random.default_rng(3)
    sets = {(i, i % 7): set(rng.integers(0, 400, 30).tolist()) for i in range(60)}
    records = [(np.uint64(e), np.uint64(a), np.uint32(b)) for (a, b), s in sets.items() for e in sorted(s)]
    split = lambda rows: pd.concat([pd.DataFrame({"bucket": x.column(0).to_pylist(), **{f"c{i}": x.column(i + 1).to_pylist() for i in range(x.num_columns - 1)}}) for x in rows])
    sent = split([x for part in (records[:900], records[900:]) for x in j._send_elements(*map(np.array, zip(*part, strict=True)), 16)])
    counts = pd.concat([j._count_elements(g, 16) for _, g in sent.groupby("bucket")])
    assert len(counts) <= 16 * 16  # rows are told by buckets, not by sets and their elements
    got = pd.concat([j._sum_elements(g) for _, g in counts.groupby("bucket")])
    assert len(got) == len(set(zip(got["s1"], got["s2"]))) <= len(sets)
    found = {(a, b): n for a, b, n in got.itertuples(index=False)}
    for k, s in sets.items():
        assert found.get(k, 0) >= sum(any(e in t for o, t in sets.items() if o != k) for e in s)  # never too few
