import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from lodestack.llm.packing import best_fit, lower_bound, pack, sequences
from lodestack.llm.textarrays import batches
from lodestack.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["it's", "DON'T", "ß", "ÄÖ", "é", "é", "ΣΑΣ", "İx", "１２", "<|endoftext|>", "a<|startoftext|>b", "x y", " ", "日本語", "🙂", "a\x00b", "'ll've", "1234", "--..!!", "µ", "×", "ﬁ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=12)), max_size=12).map(" ".join))
def test_ids_are_the_tokenizers(text):
    for _, _, b in batches(pa.array([text, "it", text])):
        ids, ends = WordEncoder(PATH).encode(b)
        expected = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids[: ends[1]].tolist() == expected and ids[ends[2] :].tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_packing(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets, room = best_fit(x, 20)
    for b in range(len(room)):
        own = sorted((o, n) for o, n, z in zip(offsets, lengths, bins, strict=True) if z == b)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == 20 - room[b]

    def fewest(rest, open_):
        if not rest:
            return len(open_)
        best = fewest(rest[1:], (*open_, 20 - rest[0])) if len(open_) < len(room) else len(room)
        for i, r in enumerate(open_):
            if r >= rest[0] and r not in open_[:i]:
                best = min(best, fewest(rest[1:], (*open_[:i], r - rest[0], *open_[i + 1 :])))
        return best

    bound = int(np.ceil(lower_bound(np.bincount(x, minlength=21), 20) - 1e-9))
    assert bound <= fewest(sorted(lengths, reverse=True), ()) <= len(room)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma", "ß-9"], k=rng.choice([1, 5, 30, 60]))), i) for i in range(3000)]
    rows += [(9000, None, 0), (9001, "", 0), (9002, "word " * 5000, 0), (None, "x", 0), (9003, "x", 0), (9003, "x", 0)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, 64, group=500, with_ids=True)
    got = out.collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text, _ in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        if i == 9003:
            assert len(own) == 2
            continue
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + 64], "<u4").tobytes()
            assert (r["length"], r["ids_crc32"], bytes(r["ids"])) == (len(part) // 4, zlib.crc32(part), part)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    lengths = np.bincount([r["length"] for r in got], minlength=65)
    assert len(by_sequence) <= np.ceil(lower_bound(lengths, 64)) + 2
    assert {len(r["ids"]) for r in sequences(out).collect()} <= set(range(1, 65))


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    (row,) = pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).collect()
    assert (row["length"], row["piece"], row["offset"]) == (1, 0, 0)
