"""Token ids of whole texts by a word BPE file of the tokenizers library, each distinct word encoded once a batch.

The file's pre-tokenizer drops white space and never joins what white space parts, so a text's ids are its
words' ids in order. Plain words (ASCII and precomposed Latin-1 letters, which the normalizer only lower-cases;
no apostrophes and no "<|") are cut further, as the pre-tokenizer does, into runs of letters, single digits and
runs of other characters, and merged by tiktoken with the file's own merges. All other words are encoded by
the tokenizer itself. Words are cut on bytes, distinct ones found by sorting hashes, and their ids gathered by
numpy. Tests hold the result against the tokenizer on whole texts.
"""
from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from lodestack.llm.textarrays import LOWER, SPACES, Batch

#: Marks a word's end in merges; no UTF-8 text holds this byte.
_END = b"\xff"
#: Of each byte: space, letter, digit, other ASCII, or no byte of a plain word.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[39] = ODD  # an apostrophe may begin a contraction
_KIND[SPACES] = SPACE
#: Distinct words kept between batches; bounds a worker's memory.
CACHE_WORDS = 500_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _load(path: str) -> tuple[Tokenizer, tiktoken.Encoding | None, np.ndarray]:
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, letters = model.get("end_of_word_suffix") or "", _byte_letters()
    if not suffix:
        return tokenizer, None, np.empty(0, np.uint32)

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + _END * end

    order = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)}
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        order.setdefault(raw(a) + raw(b), len(order))
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix(suffix))}
    known = np.array([ids.get(k, 0) for k in order], np.uint32)
    return tokenizer, tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=order, special_tokens={}), known


class WordEncoder:
    """Encodes batches of texts; keeps the ids of words it has met, up to CACHE_WORDS."""

    def __init__(self, path: str):
        self.tokenizer, self.merges, self.known = _load(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _new(self, plain: list[bytes], odd: list[bytes]) -> None:
        """Encode words that are not in the cache."""
        if len(self.at) + len(plain) + len(odd) > CACHE_WORDS:
            self._clear()
        merge = self.merges._core_bpe.encode_single_piece if plain else None
        merged = [merge(w + _END) for w in plain]
        flat = self.known[np.fromiter(itertools.chain.from_iterable(merged), np.int64)]
        given = [e.ids for e in self.tokenizer.encode_batch_fast([w[1:].decode() for w in odd], add_special_tokens=False)]
        self.at.update(zip(itertools.chain(plain, odd), range(len(self.ends) - 1, len(self.ends) - 1 + len(plain) + len(odd))))
        lengths = np.fromiter(map(len, itertools.chain(merged, given)), np.int64)
        self.flat = np.concatenate([self.flat, flat, np.fromiter(itertools.chain.from_iterable(given), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _pieces(self, words: Batch) -> tuple[Batch, np.ndarray]:
        """The batch cut into what is encoded at once, plain words in lower case; and which pieces are plain."""
        buf = words.buf
        kind = _KIND[buf]
        if len(buf):
            wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
            kind[wide], kind[wide + 1] = LETTER, LETTER
            special = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
            kind[special] = ODD
        if self.merges is None:
            kind[kind != SPACE] = ODD
        bad = np.concatenate([[0], np.cumsum(kind == ODD)])
        odd = np.flatnonzero(bad[words.end] > bad[words.start])
        mark = np.zeros(len(buf) + 1, np.int8)
        np.add.at(mark, words.start[odd], 1)
        np.add.at(mark, words.end[odd], -1)
        kind[np.cumsum(mark[:-1]) > 0] = ODD
        lower = np.where(kind == ODD, buf, LOWER[buf])
        if len(buf):
            up = wide[(buf[wide + 1] <= 0x9E) & (kind[wide] != ODD)] + 1
            lower[up] += 32
        cut = np.zeros(len(buf) + 1, bool)
        cut[words.start] = True
        cut[words.end] = True
        if len(buf):
            cut[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        keep = kind[start] != SPACE
        out = Batch.__new__(Batch)
        out.buf, out.bounds, out.start, out.end = lower, words.bounds, start[keep], end[keep]
        out.first = np.searchsorted(out.start, words.bounds)
        return out, kind[out.start] != ODD

    def encode(self, words: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, one after another, and the bounds of each text's ids."""
        batch, plain = self._pieces(words)
        if not len(batch.start):
            return np.empty(0, np.uint32), np.zeros(len(batch.bounds), np.int64)
        h = batch.hashes()
        h[~plain] ^= np.uint64(0x9E3779B97F4A7C15)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = batch.buf.tobytes()
        spelled = [raw[a:b] if p else b" " + raw[a:b] for a, b, p in zip(batch.start[first].tolist(), batch.end[first].tolist(), plain[first].tolist(), strict=True)]
        new = [w for w in spelled if w not in self.at]
        if new:
            if len(self.at) + len(new) > CACHE_WORDS:
                new = spelled
            self._new([w for w in new if w[0] != 32], [w for w in new if w[0] == 32])
        index = np.fromiter(map(self.at.__getitem__, spelled), np.int64, len(spelled))[which]
        starts = self.ends[index]
        lengths = self.ends[index + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
        return self.flat[places], ends[batch.first]
