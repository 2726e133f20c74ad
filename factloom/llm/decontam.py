"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from a window; words at ignored positions may differ. Seeds of all benchmark
items and of all training documents are joined. Around each hit, both texts are laid upon each other on the hit's diagonal, and the
stretch that has most matches less ``PENALTY`` per mismatch (of equal ones, that which begins and ends first) is the overlap. It counts if it matches ``matched`` words, or ``share`` of an
item's words where that is fewer. Substituted words are tolerated thereby, in seeds and in overlaps.

Benchmarks are split so that the seeds and words of one part, which go to every task, stay under ``INDEX_WORDS``; parts are joined one by
one. An item shorter than the masks has one seed, all its words in order.

Null texts and texts without words hold nothing and are in nothing. A null ``doc_id`` or ``item_id`` is reported as null. Repeated rows are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.packs import word_batches
from factloom.llm.shared import bounded, pieces, texts_of

#: Selected positions of windows of 12 words: 8 of each, weight enough that chance hits are rare, and no two masks share many gaps.
MASKS = ("111010010111", "110110101011", "101100111101")
MATCHED, SHARE, PENALTY = 12, 0.8, 2
#: Words of a part of the benchmark; a longer benchmark is joined part by part.
INDEX_WORDS = 2_000_000
#: Words of diagonals that are laid upon each other at once; bounds memory, never results.
CELLS = 1 << 21
_BITS = 22
_FOUND = "doc_id long, item_id long, start_word int, n_words int, matched int"


def seeds(hash_: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the words that ``mask`` selects from the windows that begin at ``at``."""
    total = np.full(len(at), len(mask), dtype=np.uint64)
    for k, selected in enumerate(mask):
        if selected == "1":
            total += hash_[at + k] * (tokens.mix(np.array([k + 1], dtype=np.uint64)) | np.uint64(1))
    return tokens.mix(total)


class Index:
    """Seeds of a part of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS, matched: int = MATCHED, share: float = SHARE, penalty: int = PENALTY):
        self.ids = [i for i, _ in items]
        self.penalty = penalty
        w = tokens.words(pa.array([t for _, t in items], pa.large_string()))
        self.hash, self.first = w.hash, w.first
        count = np.diff(w.first)
        self.least = np.minimum(matched, np.maximum(1, np.ceil(share * count - 1e-9))).astype(np.int64)
        span = max(map(len, masks))
        shorter = sorted({int(n) for n in count if 0 < n < span})
        self.masks: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in [*masks, *("1" * n for n in shorter)]:
            at, owner = tokens.windows(w, len(mask))
            wanted = count[owner] >= span if mask in masks else count[owner] == len(mask)
            at, owner = at[wanted], owner[wanted]
            key = seeds(w.hash, at, mask)
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << _BITS, dtype=bool)
            sieve[key >> np.uint64(64 - _BITS)] = True
            self.masks.append((mask, key[order], owner[order], (at - w.first[owner])[order], sieve))

    def overlaps(self, w: tokens.Words) -> list[tuple[int, int, int, int, int]]:
        """``(document, item, start, words, matched)``: the best overlap of each document and item that have one."""
        found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for mask, key, item, place, sieve in self.masks:
            at, owner = tokens.windows(w, len(mask))
            if not len(at) or not len(key):
                continue
            own = seeds(w.hash, at, mask)
            maybe = np.flatnonzero(sieve[own >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(key, own[maybe], side="left"), np.searchsorted(key, own[maybe], side="right")
            upto = np.cumsum(high - low)
            begin = 0
            while begin < len(maybe):  # so many hits at once; a diagonal that is hit often counts once
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CELLS)))
                hits = (high - low)[begin:end]
                k = np.repeat(maybe[begin:end], hits)
                entry = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low[begin:end], hits)
                found.append(_distinct(np.stack([owner[k], item[entry], at[k] - w.first[owner[k]] - place[entry]])))
                begin = end
        diagonals = _distinct(np.concatenate(found, axis=1))
        best: list[np.ndarray] = [np.zeros((6, 0), np.int64)]
        d, i, shift = diagonals
        from_ = np.maximum(0, -shift)
        length = np.minimum(np.diff(self.first)[i], np.diff(w.first)[d] - shift) - from_
        upto, begin = np.cumsum(length + 1), 0
        while begin < len(d):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CELLS)))
            part = slice(begin, end)
            best.append(self._laid(w, d[part], i[part], shift[part], from_[part], length[part]))
            begin = end
        d, i, start, n, matched, shift = np.concatenate(best, axis=1)
        order = np.lexsort((shift, start, -matched, i, d))
        d, i, start, n, matched = (x[order] for x in (d, i, start, n, matched))
        first = np.ones(len(d), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        return list(zip(*(x[first].tolist() for x in (d, i, start, n, matched)), strict=True))

    def _laid(self, w: tokens.Words, d, i, shift, from_, length) -> np.ndarray:
        """``(document, item, start, words, matched, shift)`` of diagonals whose best stretch counts; all are laid upon each other at once, one behind the other."""
        size = length + 1  # a sum before the first word, too
        at = np.cumsum(size) - size
        line = np.repeat(np.arange(len(d)), size)
        k = np.arange(len(line)) - at[line]
        inside = k > 0
        of, step = line[inside], k[inside] - 1 + from_[line[inside]]
        same = self.hash[self.first[i[of]] + step] == w.hash[w.first[d[of]] + step + shift[of]]
        gain = np.zeros(len(line), np.int64)
        gain[inside] = np.where(same, 1, -self.penalty)
        sums = np.cumsum(gain)
        sums -= sums[at][line]
        # lower by more than a line can fall, so that each line's least sum begins anew
        drop = np.int64((self.penalty + 1) * (int(size.max(initial=0)) + 1)) * line
        least = np.minimum.accumulate(sums - drop) + drop
        rise = sums - least
        most = np.maximum.reduceat(rise, at)
        stop = _first_of(rise == most[line], line)
        start = _first_of(sums == least[stop][line], line)
        ok = np.zeros(len(line), np.int64)
        ok[inside] = same
        matches = np.cumsum(ok)
        matched = matches[stop] - matches[start]
        keep = matched >= self.least[i]
        rows = np.stack([d, i, from_ + shift + start - at, stop - start, matched, shift])
        return rows[:, keep]


def _distinct(columns: np.ndarray) -> np.ndarray:
    """Distinct columns of three rows, sorted."""
    columns = columns[:, np.lexsort(columns[::-1])]
    fresh = np.ones(columns.shape[1], dtype=bool)
    fresh[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    return columns[:, fresh]


def _first_of(flags: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The first place of each line that has a flag; each has one."""
    at = np.flatnonzero(flags)
    return at[np.concatenate([[True], line[at][1:] != line[at][:-1]])] if len(at) else at


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of parts of ``benchmark (item_id, text)`` of about ``INDEX_WORDS`` words at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(chars / 5 / INDEX_WORDS))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        if rows:
            yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0], x[1])))


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in word_batches(batches):
            found = index.overlaps(batch.as_words())
            docs = [int(batch.ids[d]) if batch.valid[d] else None for d, *_ in found]
            columns = [docs, [index.ids[x[1]] for x in found], *([x[k] for x in found] for k in (2, 3, 4))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "matched"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, matched)``: the best overlap of each document with each item that it overlaps."""
    spark = docs.sparkSession
    source = texts_of(docs)
    found = [source.mapInArrow(_find(spark.sparkContext.broadcast(index)), _FOUND) for index in indexes(benchmark)]
    result = found[0] if found else spark.createDataFrame([], _FOUND)
    for more in found[1:]:
        result = result.unionAll(more)
    return result


def _clean(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in (p for b in batches for p in pieces(b)):
            keep = np.ones(batch.num_rows, dtype=bool)
            texts = batch.column(text_at)
            for at, to in tokens.slices(texts):
                for d, *_ in index.overlaps(tokens.words(texts.slice(at, to - at))):
                    keep[at + d] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap a benchmark item; a null text overlaps none."""
    spark = bounded(docs.sparkSession)
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(index), docs.columns.index("text")), docs.schema)
    return docs


def brute_contaminated(docs: list[tuple], items: list[tuple], matched: int = MATCHED, share: float = SHARE, penalty: int = PENALTY) -> set[tuple]:
    """``(doc_id, item_id)`` whose best overlap on any diagonal counts, for tests; without seeds, so that it finds all of them."""
    import re

    def words(text):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = set()
    passages = [(i, words(t)) for i, t in items]
    for doc, text in docs:
        own = words(text)
        for item, passage in passages:
            if not passage:
                continue
            least = min(matched, max(1, math.ceil(share * len(passage) - 1e-9)))
            for shift in range(-len(passage) + 1, len(own)):
                best = score = run = most = 0
                for k in range(max(0, -shift), min(len(passage), len(own) - shift)):
                    if passage[k] == own[k + shift]:
                        score, run = score + 1, run + 1
                    else:
                        score -= penalty
                    if score < 0:
                        score = run = 0
                    if score > best:
                        best, most = score, run
                if most >= least:
                    out.add((doc, item))
                    break
    return out
