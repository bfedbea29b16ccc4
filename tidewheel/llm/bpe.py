"""Byte-level BPE ids for whole Arrow columns, equal to ``Tokenizer.encode(add_special_tokens=False)``.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so the ids of a
pre-token can be kept.  Pre-token borders, their hashes and the assembly of ids are
vectorised; only a pre-token not met before goes through the ``tokenizers`` library.  Texts
with characters whose classes this module does not decide (outside Latin-1 letters, digits,
printable ASCII and common blanks, or with apostrophes that may be contractions) and
tokenizers of another make go through the library whole.  A pre-token is found by its hash and
taken only if its bytes are those the ids were made from, so ids are exact.
"""
from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from tidewheel.llm import text as tx

KEEP = 2_000_000  # pre-tokens kept per worker, about 60 bytes each; beyond it the store starts afresh
KEEP_BYTES = 1 << 26  # and of their text
_BITS = 21
_MASK = np.uint64((1 << _BITS) - 1)
_OTHER, _LETTER, _DIGIT, _BLANK, _UNSURE = range(5)
_ASCII = np.full(256, _UNSURE, np.uint8)
_ASCII[33:127] = _OTHER
_ASCII[65:91] = _ASCII[97:123] = _LETTER
_ASCII[48:58] = _DIGIT
_ASCII[[9, 10, 13, 32]] = _BLANK


def _byte_alphabet() -> dict[int, str]:
    """GPT-2's printable stand-in for each byte: printable Latin-1 stays, the rest moves above 255."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Encoder:
    """Ids of texts by a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        self.by_parts = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
        )
        self.special = [x["content"].encode() for x in made.get("added_tokens", [])]
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros(1 << _BITS, np.uint64)  # hash that holds each cell, 0: none
        self.cell = np.zeros(1 << _BITS, np.int32)  # its number in the pool
        self.known = np.zeros(0, np.uint64)  # sorted hashes that found their cell taken
        self.slot = np.zeros(0, np.int32)
        self.pool: np.ndarray = np.zeros(1 << 20, np.uint32)
        self.pool_at: np.ndarray = np.zeros((1 << 18) + 1, np.int64)
        self.text: np.ndarray = np.zeros(1 << 18, np.uint64)  # 8-byte pieces of the pre-tokens in the pool
        self.text_at: np.ndarray = np.zeros(1 << 18, np.int64)
        self.size: np.ndarray = np.zeros(1 << 18, np.int64)
        self.count = self.used = self.used_text = 0

    def _piece(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]

    def _pool(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode spans and put them in the pool; their numbers."""
        whole = raw.tobytes()
        new = [self._piece(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint32, int(sizes.sum()))
        piece, _, first = tx.lanes(raw, starts, ends - starts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used_text + len(piece) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.count + len(new) >= len(self.size):
            self.pool_at = np.concatenate([self.pool_at, np.zeros_like(self.pool_at)])
            self.text_at = np.concatenate([self.text_at, np.zeros_like(self.text_at)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        number = np.arange(self.count, self.count + len(new), dtype=np.int32)
        self.pool[self.used : self.used + len(flat)] = flat
        self.pool_at[number + 1] = self.used + np.cumsum(sizes)
        self.text[self.used_text : self.used_text + len(piece)] = piece
        self.text_at[number] = self.used_text + first
        self.size[number] = ends - starts
        self.used, self.used_text, self.count = self.used + len(flat), self.used_text + len(piece), self.count + len(new)
        return number

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        number = self._pool(raw, starts, ends)
        at = (hashes & _MASK).astype(np.int64)
        free = np.flatnonzero(self.table[at] == 0)
        free = free[np.unique(at[free], return_index=True)[1]]
        self.table[at[free]], self.cell[at[free]] = hashes[free], number[free]
        rest = np.ones(len(hashes), bool)
        rest[free] = False
        to = np.searchsorted(self.known, hashes[rest])  # both are sorted: a merge
        self.known = np.insert(self.known, to, hashes[rest])
        self.slot = np.insert(self.slot, to, number[rest])

    def _unlike(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Spans whose bytes are not those of their number: equal hashes of different pre-tokens."""
        sizes = ends - starts
        bad = self.size[number] != sizes
        piece, nth, first = tx.lanes(raw, starts, sizes)
        if len(piece) == len(starts):
            return np.flatnonzero(bad | (self.text[self.text_at[number]] != piece))
        count = np.diff(np.append(first, len(piece)))
        there = np.minimum(np.repeat(self.text_at[number], count) + nth, self.used_text - 1)
        return np.flatnonzero(bad | np.logical_or.reduceat(self.text[there] != piece, first))

    def _slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = tx.span_hashes(raw, starts, ends)
        if self.count > KEEP or self.used_text > KEEP_BYTES // 8:
            self._clear()
        at = (hashes & _MASK).astype(np.int64)
        out = self.cell[at]
        miss = np.flatnonzero(self.table[at] != hashes)
        if len(miss):
            distinct, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            to = np.searchsorted(self.known, distinct)
            found = np.zeros(len(distinct), bool)
            if len(self.known):
                found = self.known[np.minimum(to, len(self.known) - 1)] == distinct
            number = np.zeros(len(distinct), np.int32)
            number[found] = self.slot[to[found]]
            new = np.flatnonzero(~found)
            number[new] = np.arange(self.count, self.count + len(new))
            self._learn(raw, distinct[new], starts[miss[first[new]]], ends[miss[first[new]]])
            out[miss] = number[back.reshape(-1)]
        unlike = self._unlike(raw, starts, ends, out)
        if len(unlike):
            out[unlike] = self._pool(raw, starts[unlike], ends[unlike])
        return out

    @staticmethod
    def _classes(raw: np.ndarray) -> np.ndarray:
        kind = _ASCII[raw]
        lead = np.flatnonzero((raw == 0xC3) | (raw == 0xC2))
        lead = lead[lead + 1 < len(raw)]
        c3 = lead[raw[lead] == 0xC3]
        c3 = c3[(raw[c3 + 1] != 0x97) & (raw[c3 + 1] != 0xB7)]  # not the signs for times and divided by
        kind[c3] = kind[c3 + 1] = _LETTER
        return kind

    def _borders(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of pre-tokens, which documents are not sure to be split right)."""
        n = len(raw)
        kind = self._classes(raw)
        first = np.zeros(n + 1, bool)
        first[offs[:-1][offs[:-1] < n]] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= first[:n]
        start = change.copy()
        blank = kind == _BLANK
        last = blank.copy()  # the last blank before a non-blank of the same document
        last[:-1] &= ~blank[1:] & ~first[1:n]
        last[-1:] = False
        start[last] = True  # the blanks before it are a pre-token of their own
        joins = np.flatnonzero(last & (raw == 32)) + 1
        start[joins] = False  # one space goes with what follows
        unsure = kind == _UNSURE
        tick = np.flatnonzero(raw == 39)
        tick = tick[(tick + 1 < n) & start[tick]]
        unsure[tick[np.isin(raw[np.minimum(tick + 1, n - 1)], np.frombuffer(b"stmdrvl", np.uint8))]] = True
        bad = np.add.reduceat(np.append(unsure, False).astype(np.int64), np.minimum(offs[:-1], n)) > 0
        bad &= offs[1:] > offs[:-1]
        return np.flatnonzero(start), bad

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, index of each document's first id; n + 1 of these) of one chunk."""
        docs = len(offs) - 1
        if not self.by_parts or not len(raw):
            bad = offs[1:] > offs[:-1]
            starts = np.zeros(0, np.int64)
        else:
            starts, bad = self._borders(raw, offs)
            for word in self.special:
                if (whole := raw.tobytes()).find(word) >= 0:
                    bad |= np.array([whole.find(word, a, b) >= 0 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
        if len(starts):
            of = np.searchsorted(offs, starts, side="right") - 1
            ends = np.append(starts[1:], len(raw))
            keep = ~bad[of]
            starts, ends, of = starts[keep], ends[keep], of[keep]
        if len(starts):
            slot = self._slots(raw, starts, ends)
            sizes = self.pool_at[slot + 1] - self.pool_at[slot]
            total = int(sizes.sum())
            at = np.cumsum(sizes) - sizes
            ids = self.pool[np.repeat(self.pool_at[slot] - at, sizes) + np.arange(total)]
            counts = np.bincount(of, weights=sizes, minlength=docs).astype(np.int64)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        if bad.any():
            own = np.split(ids, np.cumsum(counts)[:-1])
            rows = np.flatnonzero(bad)
            texts = [raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
            for i, x in zip(rows, self.whole.encode_batch(texts, add_special_tokens=False)):
                own[i] = np.array(x.ids, np.uint32)
                counts[i] = len(own[i])
            ids = np.concatenate(own) if own else ids
        return ids, np.concatenate([[0], np.cumsum(counts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
