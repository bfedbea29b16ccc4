"""Vectorised views of text columns: numpy over Arrow buffers, no Python string per word.

Words are maximal runs of ASCII letters and digits and of all non-ASCII characters
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z).  In UTF-8 every byte of a
non-ASCII character is 0x80 or more, so byte classes find the same words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text handled at once; one longer text is one chunk
KEY = np.uint64(0xA0761D6478BD642F)  # hashes stand in stored fingerprints: one key for all jobs
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.large_string())
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(col, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``most`` bytes."""
    raw, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lanes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-byte pieces of all spans, each padded by zeros, number of the piece in its span, index of each span's first piece)."""
    count = np.maximum((sizes + 7) >> 3, 1)
    first = np.cumsum(count) - count
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))
    if len(count) and count.max() > 1:
        nth = np.arange(int(count.sum())) - np.repeat(first, count)
        piece = eights[np.repeat(starts, count) + 8 * nth]
        last = first + count - 1
    else:
        nth, piece, last = np.zeros(len(starts), np.int64), eights[starts], slice(None)
    piece[last] &= _KEEP[sizes - 8 * (count - 1)]
    return piece, nth, first


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand.

    The sum, over a span's 8-byte pieces, of a mixed value of piece and place: unlike a polynomial
    modulo 2^64, no regular pair of texts is sure to collide.  Where a collision would give a
    wrong result (token ids), the bytes are compared too.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    piece, nth, first = lanes(raw, starts, sizes)
    each = mix((piece ^ KEY) + nth.astype(np.uint64) * _STEP)
    total = np.add.reduceat(each, first) if len(each) > len(starts) else each
    return mix(total + sizes.astype(np.uint64) * _STEP)


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, index of each document's first word; n + 1 of these)."""
    low = LOWER[raw]
    inside = IS_WORD[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[:n] = inside
    edge[1:] ^= inside
    # a document's first byte starts a word even if the previous document ends inside one
    cut = offs[(offs > 0) & (offs < n)]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cut):
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each document's first word)."""
    low, starts, ends, first = words(raw, offs)
    return span_hashes(low, starts, ends), first
