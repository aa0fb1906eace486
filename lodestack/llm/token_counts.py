"""Token counts of whole texts by a byte-level BPE file of the tokenizers library, without encoding most of them.

Whole-token shortcut: of each vocabulary string it is proved offline, with the tokenizer itself, whether it encodes
alone as one token. Texts are cut into pre-tokens; those among the proved strings count one, and only the rest, each
distinct one once, is merged by the tokenizer. No text is encoded as a whole.

Texts are cut on bytes by numpy where their characters leave no doubt: ASCII and the letters of Latin-1. A stretch
between white space that holds any other character, a contraction's apostrophe or the text of a special token is given
to the tokenizer as it stands, which then cuts it by its own rules, special tokens included; so what counts as
a letter is decided by one library only. Tests hold the counts against the library on whole texts.
"""
from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestack.llm.textarrays import SPACES, Batch, pieces, utf8

#: Of each byte: white space, letter, digit, other ASCII, part of a character that is left to the tokenizer.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0:128] = OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[SPACES] = SPACE
_KIND[28:32] = ODD  # separators that some libraries count as white space
_KIND[39] = ODD  # an apostrophe may begin a contraction
#: Counts of pre-tokens that are kept between batches, and bytes of text that are cut at a time; both bound a worker's memory.
CACHE, PIECE = 200_000, 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def count_each(tokenizer: Tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def proved(path: str) -> frozenset[bytes]:
    """The vocabulary strings that are text and that the tokenizer encodes alone as one token, as bytes."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters, found = byte_letters(), []
    for token in vocabulary:
        try:
            found.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # not text by itself: no pre-token can be this
            continue
    return frozenset(t.encode() for t, n in zip(found, count_each(load(path), found), strict=True) if n == 1)


@functools.cache
def odd_texts(path: str) -> tuple[bytes, ...]:
    """Texts of added tokens, which the tokenizer finds before it cuts."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"].encode() for t in json.load(f).get("added_tokens", []))


class TokenCounter:
    """Counts tokens of batches of texts; keeps counts of the pre-tokens that it had to merge, up to CACHE."""

    def __init__(self, path: str):
        self.tokenizer, self.whole, self.added = load(path), proved(path), odd_texts(path)
        self.merged: dict[bytes, int] = {}

    def cut(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[Batch, np.ndarray]:
        """The pre-tokens of texts, and which of them are stretches left to the tokenizer.

        A stretch is white space and what follows up to the next white space: nothing the tokenizer looks for spans
        a place where ASCII white space follows another character. In a plain stretch the last of its white space
        begins the first pre-token if it is a space, and else stands alone; what is before it is one pre-token.
        """
        n = len(buf)
        kind = _KIND[buf]
        if n > 1:
            wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
            kind[wide], kind[wide + 1] = LETTER, LETTER
        raw = buf.tobytes()
        for text in self.added:
            at = raw.find(text)
            while at >= 0:
                kind[at : at + len(text)] = ODD
                at = raw.find(text, at + 1)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        edge[n] = True
        space = kind == SPACE
        # Unicode's white space begins with one of these bytes; it is never parted from white space beside it
        blank = self._unicode_spaces(buf)
        cut = edge.copy()
        cut[1:n] |= space[1:] & ~space[:-1] & ~blank[:-1]
        start = np.flatnonzero(cut)[:-1]
        end = np.flatnonzero(cut)[1:]
        bad = np.concatenate([[0], np.cumsum(kind == ODD)])
        odd = bad[end] > bad[start]
        mark = np.zeros(n + 1, np.int8)
        mark[start[odd]] += 1
        mark[end[odd]] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        k = np.where(inside, np.uint8(ODD), kind)
        if n > 1:
            turn = k[1:] != k[:-1]
            last = np.zeros(n - 1, bool)  # before the last white space of a run that something follows
            last[:-1] = (k[1:-1] == SPACE) & (k[2:] != SPACE) & ~edge[2:n] & (k[2:] != ODD)
            last &= k[:-1] == SPACE
            # one space belongs to what follows
            joined = (k[:-1] == SPACE) & (buf[:-1] == 32) & (k[1:] != SPACE) & ~inside[1:]
            cut[1:n] |= (turn & ~joined) | last
        start, end = np.flatnonzero(cut)[:-1], np.flatnonzero(cut)[1:]
        out = Batch.__new__(Batch)
        out.buf, out.bounds, out.start, out.end = buf, bounds, start, end
        out.first = np.searchsorted(start, bounds)
        return out, k[start] == ODD

    @staticmethod
    def _unicode_spaces(buf: np.ndarray) -> np.ndarray:
        """The last bytes of characters that may be white space beyond ASCII, and of others that begin like them."""
        out = np.zeros(len(buf), bool)
        for lead, rest in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):
            at = np.flatnonzero(buf == lead) + rest
            out[at[at < len(buf)]] = True
        out[(buf >= 28) & (buf < 32)] = True
        return out

    def counts(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        parts, odd = self.cut(buf, bounds)
        if not len(parts.start):
            return np.zeros(len(bounds) - 1, np.int64)
        h = parts.hashes()
        h[odd] ^= np.uint64(0x9E3779B97F4A7C15)  # a stretch may be spelled like a pre-token
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        spelled = [raw[a:b] for a, b in zip(parts.start[first].tolist(), parts.end[first].tolist(), strict=True)]
        rest = [i for i, (w, o) in enumerate(zip(spelled, odd[first].tolist(), strict=True)) if o or w not in self.whole]
        new = list({spelled[i] for i in rest} - self.merged.keys())
        if len(self.merged) + len(new) > CACHE:
            self.merged.clear()
            new = list({spelled[i] for i in rest})
        self.merged.update(zip(new, count_each(self.tokenizer, [w.decode() for w in new]), strict=True))
        each = np.ones(len(spelled), np.int64)
        each[rest] = [self.merged[spelled[i]] for i in rest]
        total = np.concatenate([[0], np.cumsum(each[which])])
        return total[parts.first[1:]] - total[parts.first[:-1]]


@functools.cache
def counter(path: str) -> TokenCounter:
    """One for all tasks that a worker runs."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row; one pass, nothing is shuffled.

    path: a byte-level BPE file of the tokenizers library. A null text is empty and has no tokens; null and repeated
    ids are rows like any other; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            buf, bounds = utf8(batch.column(1))
            n = [own.counts(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in pieces(bounds, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["_id", "n_bytes", "n_tokens"]
            )

    schema = T.StructType([T.StructField("_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(work, schema).withColumnRenamed("_id", id_col)
