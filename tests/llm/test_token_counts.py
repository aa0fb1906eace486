import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm.textarrays import utf8
from lodestack.llm.token_counts import TokenCounter, count_tokens, proved

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(PATH)
PARTS = [
    "it's", "DON'T", "'ll've", "ß", "ÄÖ", "é", "é", "ΣΑΣ", "１２", "<|endoftext|>", "a<|endoftext|>b", "<|endo", "日本語", "🙂", "a\x00b", "1234", "--..!!", "µ", "×", "²", " ", " ",
    "　", "\u0085", "\x1c", "\x1f", "᠎", "​", "the", "Internationalization", "zqxjk", " ", "  ", "\n", "\t", "\r\n", "\n\n  ", "    ", "£", "—", "“x”", "a_b", "ÃŸ", "3.14",
]


def expected(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def counted(texts):
    return COUNTER.counts(*utf8(pa.array(texts, pa.string()))).tolist()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=12), max_size=4), st.sampled_from(["", " "]))
def test_counts_are_the_tokenizers(lists, glue):
    texts = [glue.join(x) for x in lists]
    assert counted(texts) == [expected(t) for t in texts]


def test_every_pair_and_triple_of_odd_parts():
    rng = random.Random(5)
    texts = [a + b for a in PARTS for b in PARTS] + ["".join(rng.choices(PARTS, k=rng.randint(3, 9))) for _ in range(4000)]
    assert counted(texts) == [expected(t) for t in texts]


def test_proved_strings_are_one_token_alone():
    whole = proved(PATH)
    assert b" the" in whole and len(whole) > 40_000
    sample = random.Random(1).sample(sorted(whole), 2000)
    assert all(expected(w.decode()) == 1 for w in sample)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("lodestack.llm.token_counts.CACHE", 10)
    counter = TokenCounter(PATH)
    texts = [f"zq{i}xj qq{i}'s" for i in range(40)]
    for t in texts:
        assert counter.counts(*utf8(pa.array([t]))).tolist() == [expected(t)]
    assert len(counter.merged) <= 10


def test_tables(spark):
    long = "x" * 60_000 + " " + "wörd " * 30_000
    rows = [(1, None, 5, "n"), (2, "", 5, "n"), (None, "it's  fine\n", 5, "n"), (3, long, 5, "n"), (3, long, 5, "n"), (2**62, "<|endoftext|> <|endoftext|>", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    out = count_tokens(docs, PATH).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(str((i, len((t or "").encode()), expected(t))) for i, t, *_ in rows)
    assert count_tokens(docs.limit(0), PATH).count() == 0
    assert [f.dataType.typeName() for f in count_tokens(docs, PATH).schema] == ["long", "long", "long"]


def test_empty_batch():
    assert COUNTER.counts(np.empty(0, np.uint8), np.zeros(3, np.int64)).tolist() == [0, 0]
