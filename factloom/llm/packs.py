"""Number arrays packed into compressed bytes, and batches of words, for shuffles of many small numbers in few rows.

A shuffled row per word costs tens of bytes; here a row holds all numbers that one batch of documents has for one receiver.
Sorted keys are kept as differences, bytes of equal weight lie together, and zstandard takes what redundancy is left.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from factloom.llm import tokens

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None

#: Words of a batch; bounds a Python worker's memory, never results.
BATCH_WORDS = 500_000


def trim() -> None:
    """Gives memory that was freed back to the system: workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Bytes of unsigned integer arrays of equal length; the first one must be sorted."""
    n = len(arrays[0])
    out = [np.array([n, *(a.dtype.itemsize for a in arrays)], dtype=np.uint32).tobytes()]
    for k, a in enumerate(arrays):
        if k == 0 and n:
            a = np.diff(a, prepend=a.dtype.type(0))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    head = raw[: 4 * (count + 1)].view(np.uint32)
    n, at, out = int(head[0]), 4 * (count + 1), []
    for k in range(count):
        width = int(head[k + 1])
        a = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(f"<u{width}").ravel()
        at += n * width
        out.append(np.cumsum(a, dtype=a.dtype) if k == 0 else a)
    return out


class WordBatch:
    """Words of some documents: ``ids`` (a null one has ``valid`` false), ``hash`` of all words, ``first`` bounds of each document's."""

    __slots__ = ("end", "first", "hash", "ids", "number", "start", "valid")

    def __init__(self, number, ids, valid, hash_, first, start, end):
        self.number, self.ids, self.valid, self.hash, self.first, self.start, self.end = number, ids, valid, hash_, first, start, end

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def as_words(self) -> tokens.Words:
        return tokens.Words(self.hash, self.start, self.end, self.first)


def word_batches(batches: Iterable[pa.RecordBatch], most: int = BATCH_WORDS, places: bool = False, **how) -> Iterator[WordBatch]:
    """Documents ``(doc_id, text)`` in batches of about ``most`` words; a longer text stands whole in a batch of its own.

    ``number`` names a batch within the job: a task that runs again over the same input split gives the same numbers and batches.
    """
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    held: list[tuple] = []
    count = 0

    def joined() -> WordBatch:
        ids = np.concatenate([x[0] for x in held])
        valid = np.concatenate([x[1] for x in held])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2].first) for x in held]))]).astype(np.int64)
        start = np.concatenate([x[2].start for x in held]) if places else None
        end = np.concatenate([x[2].end for x in held]) if places else None
        return WordBatch(number, ids, valid, np.concatenate([x[2].hash for x in held]), first, start, end)

    for batch in batches:
        texts, ids = batch.column(1), batch.column(0)
        for at, to in tokens.slices(texts):
            w = tokens.words(texts.slice(at, to - at), **how)
            own = ids.slice(at, to - at)
            held.append((own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~own.is_null().to_numpy(zero_copy_only=False), w))
            count += len(w.hash)
            if count >= most:
                yield joined()
                held, count, number = [], 0, number + 1
    if held:
        yield joined()
        held = []
    trim()


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginning and length of each run of equal numbers."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.diff(np.append(at, len(keys)))
