"""Vectorised word hashing over Arrow string batches.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes; everything else separates words. Words are
hashed straight from the UTF-8 buffer of an Arrow array with prefix sums, so that no Python string is made per word:
with an odd base ``B``, ``H(word) = (S[end] - S[start]) * B**-start`` modulo 2**64, where ``S`` is the running sum of
``code[byte] * B**offset``. Equal byte strings have equal hashes wherever they stand. ASCII letters are folded to lower
case by the byte table; callers that want full Unicode folding apply ``lower`` to the column first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; only bounds memory, never results.
CHUNK = 1 << 19
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_B, CHUNK * 2 + 1)
_NEG = _powers(_INV, CHUNK * 2 + 1)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.arange(256, dtype=np.uint64)
    fold = b.copy()
    fold[65:91] += 32
    word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    code = mix((b + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    folded = mix((fold + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return word, code, folded


WORD, _CODE, _FOLDED = _tables()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _grow(n: int) -> None:
    global _POW, _NEG
    if n >= len(_POW):
        _POW, _NEG = _powers(_B, 2 * n), _powers(_INV, 2 * n)


class Words:
    """Words of consecutive texts: ``hash[i]`` at bytes ``start[i]:end[i]`` of its own text, ``first[d]:first[d + 1]`` being those of text ``d``."""

    __slots__ = ("end", "first", "hash", "start")

    def __init__(self, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.hash, self.start, self.end, self.first = hash_, start, end, first

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n, at = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(texts: pa.Array, whitespace: bool = False, fold: bool = True, prefix: int | None = None) -> Words:
    """Words of an Arrow string array; null is as an empty text. ``whitespace``: split at ASCII white space only. ``prefix``: hash so many bytes of each word at most."""
    raw, offsets = buffer(texts)
    _grow(len(raw) + 1)
    inside = ~_SPACE[raw] if whitespace else WORD[raw]
    flips = np.empty(len(raw) + 1, dtype=bool)
    flips[0], flips[-1] = (bool(inside[0]), bool(inside[-1])) if len(raw) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=flips[1:-1])
    edges = np.flatnonzero(flips)
    start, end = edges[0::2], edges[1::2]
    # a word never runs on into the next text: cut words at text borders
    inner = offsets[1:-1]
    if len(inner) and len(raw):
        inner = inner[(inner > 0) & (inner < len(raw))]
        inner = np.unique(inner[inside[inner] & inside[inner - 1]])
        if len(inner):
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.multiply((_FOLDED if fold else _CODE)[raw], _POW[: len(raw)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    stop = end if prefix is None else np.minimum(end, start + prefix)
    h = mix((sums[stop] - sums[start]) * _NEG[start])
    first = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(first))
    return Words(h, (start - base).astype(np.int64), (end - base).astype(np.int64), first)


def slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges ``(from, to)`` of an array whose texts hold about ``most`` bytes together; a longer text stands alone."""
    _, offsets = buffer(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words that begin a window of ``n`` words inside one text, and the windows' texts."""
    counts = np.diff(w.first)
    owner = w.owner()
    left = w.first[1:][owner] - np.arange(len(w.hash)) if len(counts) else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= n)
    return at, owner[at]


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, by position, and the text of each."""
    at, owner = windows(w, n)
    return ngram_hash(w.hash, at, n), owner


def ngram_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each index of ``at``, order counting; by prefix sums, whatever ``n`` is."""
    if n == 1:
        return h[at]
    _grow(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _POW[: len(h)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * _NEG[at] + np.uint64(n))
