"""Katz backoff language model of the whole corpus, and each document's score under it.

Every word of the documents has a number; one unknown word stands for all that none of them has (and, where ``words`` asks for the most
frequent ones only, by count and then by hash, for the others). Of n-grams of order 2 and up, those counted more than ``CUTOFF`` times are
*kept*. An n-gram of count ``r`` up to ``DISCOUNTED`` is discounted by its Good-Turing ratio

    d(r) = (r*/r - A) / (1 - A),   r* = (r + 1) n(r+1) / n(r),   A = (k + 1) n(k+1) / n(1)

(``n(r)``: distinct n-grams of count ``r``, ``k`` = ``DISCOUNTED``), that is, ``1 - d(r)`` is in proportion to ``1 - r*/r``, and all discounts
together are ``n(1)`` counts. Where one of these ratios isn't between 0 and 1, all ``r*`` of the order are taken from ``n(r)`` smoothed by a line
through its logarithms, and the discounts are ``n(1)`` counts again. ``FLAT`` is for an order whose counts allow no such estimate: no n-gram
counted once, or none from twice to ``k`` times, or a line that doesn't fall steeper than ``1 / r``. What a history ``h`` has left goes to the
words that aren't kept after it, in proportion to the next lower order:

    P(w | h) = d(c(hw)) c(hw) / c(h)                 if hw is kept
             = a(h) P(w | h without its first word)    if not
    a(h) = (1 - sum of the kept P(w | h)) / (1 - sum of P(w | h without its first word) over the same words)

so the probabilities of all words after a history sum to one exactly. A history with nothing left to give counts one more; one that was
never seen has a(h) = 1. Unigrams are (count + 1) over the sum of that, the unknown word included, so no word is impossible.

*Tables.* Distinct words of each batch of documents go to the partition of their hash, which counts and numbers them, frequent ones low, and
tells numbers and counts back; documents are written once as batches of word numbers. Order by order, the distinct n-grams of each batch go
to the partition of their history, packed, once, with their probabilities of the next lower order. The partition counts them, sums what
its histories keep and what these words have below, and answers each n-gram with its count's class and its share of the history; or, where the formula
takes more than that (an n-gram that isn't kept, a history after which every word is kept), with all that goes into it. Counts of counts of all
partitions give the discounts, with which the batches turn answers into probabilities, so the recursion of the formula
runs once per order for every token. No task ever holds more than one partition of words or n-grams, and nothing is broadcast. Above order
2, shares and probabilities travel as 32-bit floats. N-grams are known exactly, but for histories of three words out of more than 65,535: those by a 64-bit hash.

A document's words are predicted from the words before them in it, as many as there are, up to ``order - 1``. Null texts and texts
without a word have 0 tokens and a null score. Rows with a null ``doc_id`` are counted and scored like others, repeated rows each. An
empty table gives an empty table. The input must give a task that runs again the same rows, as files do.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.packs import grouped, pack, trim, unpack, word_batches
from factloom.llm.shared import exchange_parts, texts_of, written

ORDER, CUTOFF, DISCOUNTED, FLAT = 3, 0, 5, 0.75
#: Bits of a word's number in a history: if numbers fit, or else.
NARROW, WIDE = 16, 32

_SENT = pa.schema([("slot", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
_WORDS = pa.schema([("slot", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64()), ("most", pa.int64())])
_TEXTS = pa.schema([("batch", pa.int64()), ("documents", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("lower", pa.binary())])
_TOLD = pa.schema([("slot", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
_PARTS = pa.schema([("slot", pa.int32()), ("blob", pa.binary()), ("histories", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_probability", pa.float64())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_slot(history: np.ndarray, slots: int) -> np.ndarray:
    return (tokens.mix(history + np.uint64(1)) % np.uint64(slots)).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, with some place of each, every number's rank among them, and how often each is there; by one sort that needn't be stable."""
    order = np.argsort(keys)
    ordered = keys[order]
    at, length = grouped(ordered)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.repeat(np.arange(len(at)), length)
    return ordered[at], order[at], rank, length


# the vocabulary


def _words_seen(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_batches(batches):
            word, _, _, count = distinct(batch.hash)
            # hashes are spread evenly: ranges of them are equal parts
            slot = ((word >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            yield _batch(_SENT, [(int(slot[b]), batch.number, pack(word[b : b + m], count[b : b + m].astype(np.uint32))) for b, m in zip(*grouped(slot), strict=True)])

    return run


def _loose(*arrays: np.ndarray) -> bytes:
    """Packed arrays of which none is sorted."""
    return pack(np.zeros(len(arrays[0]), np.uint8), *arrays)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    at, _ = grouped(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _words_told(slots: int, chosen):
    def run(table: pa.Table) -> pa.Table:
        """Number and count of each word of one slot, for all batches that hold it and, without a batch, for the model."""
        trim()
        rows = table.to_pylist()
        sent = [unpack(r["blob"], 2) for r in rows]
        word, count = _merged(*(np.concatenate(x) for x in zip(*sent, strict=True)))
        slot, own = rows[0]["slot"], np.arange(len(word)) if chosen is None else np.flatnonzero(np.isin(word, chosen.value))
        number = np.zeros(len(word), np.uint32)
        # a slot has every so many-th number, so that all slots' frequent words have low ones
        number[own[np.argsort(-count[own], kind="stable")]] = np.arange(len(own), dtype=np.uint32) * np.uint32(slots) + np.uint32(slot + 1)
        out = [(slot, None, pack(word[own], number[own], count[own].view(np.uint64)), int(count.sum()), len(own), len(own) * slots + slot)]
        for r, (w, _) in zip(rows, sent, strict=True):
            at = np.searchsorted(word, w)
            out.append((slot, r["batch"], _loose(number[at], count[at].view(np.uint64)), None, None, None))
        return pa.Table.from_batches([_batch(_WORDS, out)])

    return run


class Vocabulary:
    """The table of all words in the shared folder; ``tokens`` in all, numbered ``words``, ``bits`` of a number in a history."""

    def __init__(self, table: DataFrame):
        self.table = table
        every = table.where("batch is null")
        tokens_, words, most = every.agg(F.sum("tokens"), F.sum("words"), F.max("most")).first()
        self.tokens, self.words, self.bits = tokens_ or 0, words or 0, NARROW if (most or 0) < 1 << NARROW else WIDE
        if (most or 0) >= 1 << WIDE:
            raise ValueError(f"more than {1 << WIDE} words")

    @property
    def total(self) -> int:
        return self.tokens + self.words + 1

    @property
    def unknown(self) -> int:
        """Tokens without a number, of a small vocabulary."""
        return self.tokens - int(self._gathered[2].sum())

    @cached_property
    def _gathered(self) -> list[np.ndarray]:
        """Hashes, numbers and counts of a small corpus on the driver, for tests and inspection."""
        blobs = [unpack(bytes(r.blob), 3) for r in self.table.where("batch is null").select("blob").collect()]
        return [np.concatenate(x) for x in zip(*blobs, strict=True)] if blobs else [np.zeros(0, np.uint64)] * 3

    @property
    def hash(self) -> np.ndarray:
        return self._gathered[0]

    @cached_property
    def unigram(self) -> np.ndarray:
        """Probabilities by number; 0 for numbers that no word has."""
        _, number, count = self._gathered
        out = np.zeros(int(number.max(initial=0)) + 1)
        out[number] = (count + 1.0) / self.total
        out[0] = (self.unknown + 1) / self.total
        return out


def vocabulary(source: DataFrame, size: int | None = None) -> Vocabulary:
    """All words of ``source (doc_id, text)``, or the ``size`` most frequent ones, which then come to the driver."""
    slots = exchange_parts(source)
    seen = source.mapInArrow(_words_seen(slots), _sql(_SENT)).groupBy("slot")
    told = Vocabulary(written(seen.applyInArrow(_words_told(slots, None), _sql(_WORDS))))
    if size is None or told.words <= size:
        return told

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word, _, n = unpack(blob, 3)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.view(np.int64))], names=["word", "n"])

    counted = told.table.where("batch is null").select("blob").mapInArrow(rows, "word long, n long")
    top = counted.orderBy(F.col("n").desc(), "word").limit(size).toArrow().column("word").to_numpy().view(np.uint64)
    chosen = source.sparkSession.sparkContext.broadcast(top)
    return Vocabulary(written(seen.applyInArrow(_words_told(slots, chosen), _sql(_WORDS))))


# n-grams of batches


def _texts_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as ranks among their own distinct words, in the order in which these are sent."""
    for batch in word_batches(batches):
        documents = pack(batch.first[:-1].astype(np.uint64), batch.first[1:].astype(np.uint64), batch.ids.view(np.uint64), batch.valid.astype(np.uint8))
        rank = distinct(batch.hash)[2]
        yield _batch(_TEXTS, [(batch.number, documents, _loose(rank.astype(np.uint32)), None, None)])


def _numbered(total: int, unknown: int, last: bool):
    """Batches as word numbers; documents get the logarithm of their first word's probability, or of all words' if no order follows."""

    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        row = texts.to_pylist()[0]
        first, end, ids, valid = unpack(row["documents"], 4)
        answers = [unpack(b, 3)[1:] for _, b in sorted((r["slot"], r["blob"]) for r in told.to_pylist())]
        number, count = [np.concatenate(x) for x in zip(*answers, strict=True)] if answers else [np.zeros(0, np.uint32), np.zeros(0, np.uint64)]
        count = np.where(number == 0, np.uint64(unknown), count)
        rank = unpack(row["words"], 2)[1]
        sums = _sums(np.log((count[rank] + 1.0) / total), first, end if last else np.minimum(end, first + np.uint64(1)))
        if last:
            return _scored(first, end, ids, valid, sums)
        own, at, place, _ = distinct(number)
        return pa.Table.from_batches([_batch(_TEXTS, [(row["batch"], pack(first, end, ids, valid, sums.view(np.uint64)), _loose(place[rank].astype(np.uint32)), pack(own, count[at]), None)])])

    return run


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[end.astype(np.int64)] - sums[first.astype(np.int64)]


def _scored(first, end, ids, valid, sums) -> pa.Table:
    count = (end - first).astype(np.int64)
    return pa.table([pa.array(ids.view(np.int64), mask=valid == 0), pa.array(count), pa.array(sums, mask=count == 0)], schema=_SCORES)


def _history(words: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ``n - 1`` words before each place, side by side, or hashed where 64 bits are too few."""
    history = np.zeros(len(at), dtype=np.uint64)
    for k in range(n - 1, 0, -1):
        word = words[at - k].astype(np.uint64)
        history = history << np.uint64(bits) | word if (n - 1) * bits <= 64 else tokens.mix(history + tokens.mix(word + np.uint64(1)))
    return history


class Grams:
    """What a batch sends for order ``n``: ``at`` has the places with ``n - 1`` words before them, ``rank`` each one's n-gram among the distinct ones, which
    are in the order in which they are sent; ``where`` is one place of each."""

    __slots__ = ("at", "counts", "history", "rank", "slot", "where", "word")

    def __init__(self, row: dict, n: int, slots: int, bits: int):
        first, last, *_ = unpack(row["documents"], 5)
        own, words = unpack(row["counts"], 2)[0], unpack(row["words"], 2)[1]
        begin = np.repeat(first, (last - first).astype(np.int64)).astype(np.int64)
        self.at = np.flatnonzero(np.arange(len(words)) - begin >= n - 1)
        # ranks among the batch's words are in the order of numbers, and narrow enough to stand side by side
        width = np.uint64(max(1, len(own).bit_length()))
        key = words[self.at - (n - 1)].astype(np.uint64)
        for k in range(n - 2, -1, -1):
            if int(width) * (n - k) > 64:
                key = distinct(key)[2].astype(np.uint64)  # a batch has fewer than 2 ** 32 places
            key = key << width | words[self.at - k]
        _, index, which, counts = distinct(key)
        where = self.at[index]
        history = _history(own[words], where, n, bits) if len(where) else np.zeros(0, np.uint64)
        slot = _by_slot(history, slots)
        # by slot, and by history and word inside it, as what is sorted packs well
        order = np.lexsort((own[words[where]], history, slot)) if n > 1 and bits * (n - 1) > 64 else np.argsort(slot.astype(np.uint16) if slots <= 1 << 16 else slot, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rank, self.history, self.word, self.counts = place[which], history[order], own[words[where]][order], counts[order].astype(np.uint32)
        self.slot, self.where = slot[order], where[order]


def _lower(row: dict, n: int, slots: int, bits: int) -> np.ndarray:
    """What goes along with the places of a batch for order ``n``: counts of their words, above order 2 probabilities of order ``n - 1``."""
    if n == 2:
        return unpack(row["counts"], 2)[1][unpack(row["words"], 2)[1]]
    before = Grams(row, n - 1, slots, bits)
    out = np.zeros(int(before.at.max(initial=-1)) + 1, np.uint32)
    out[before.at] = unpack(row["lower"], 2)[1][before.rank]
    return out


def _send(n: int, slots: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, n, slots, bits)
                if not len(grams.where):
                    continue
                sent = (grams.history, grams.word, grams.counts, _lower(row, n, slots, bits)[grams.where])
                rows = [(int(grams.slot[b]), row["batch"], pack(*(x[b : b + m] for x in sent))) for b, m in zip(*grouped(grams.slot), strict=True)]
                yield _batch(_SENT, rows)
        trim()

    return run


def _keys(sent: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams that were sent to a slot, the word's number below the history: that itself if it is narrow, else its rank in the slot."""
    history, word, counts = (np.concatenate([x[k] for x in sent]) for k in range(3))
    if bits == WIDE:
        history = distinct(history)[2].astype(np.uint64)
    return history << np.uint64(bits) | word, counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(r, n)`` of each partition: so many n-grams of count ``r``."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            seen = np.frombuffer(blob, np.int64)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(seen) + 1)), pa.array(seen)], names=["r", "n"])


def _smoothed(n: np.ndarray) -> np.ndarray:
    """Counts of counts on a line through their logarithms, each one shared with the missing ones around it (Gale and Sampson); zeros where less than two are known."""
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return np.zeros(len(n))
    before = np.append(0, r[:-1])
    after = np.append(r[1:], 2 * r[-1] - before[-1])
    slope, at = np.polyfit(np.log(r), np.log(2 * n[r - 1] / (after - before)), 1)
    return np.exp(at + slope * np.log(np.arange(1, len(n) + 1)))


def discounts(n: dict[int, int], most: int = DISCOUNTED, flat: float = FLAT) -> np.ndarray:
    """Ratios d(0..most) from counts of counts n(1..most + 1); d(0) isn't used."""
    seen, r = np.array([n.get(r, 0) for r in range(1, most + 2)], dtype=np.float64), np.arange(1, most + 1)
    for of in (seen, _smoothed(seen)):
        if of.all() and (lost := 1 - (r + 1) * of[1:] / of[:-1] / r).min() > 0:
            # 1 - d(r) in proportion to 1 - r*/r, and n(1) counts discounted in all
            ratio = 1 - lost * seen[0] / (seen[:-1] * r * lost).sum()
            if 1e-12 < ratio.min() and ratio.max() < 1:
                return np.append(flat, ratio)
    return np.full(most + 1, flat)


class Part:
    """The model of one order for some histories: ``keys`` sorted with their ``p``; ``histories`` sorted with their ``backoff``."""

    __slots__ = ("backoff", "bits", "histories", "keys", "p")

    def __init__(self, keys, p, histories, backoff, bits=NARROW):
        self.keys, self.p, self.histories, self.backoff, self.bits = keys, p, histories, backoff, np.uint64(bits)

    def evaluate(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P of n-grams, given those of the next lower order."""
        weight = np.ones(len(keys))
        if len(self.histories):
            history = keys >> self.bits
            at = np.minimum(np.searchsorted(self.histories, history), len(self.histories) - 1)
            weight = np.where(self.histories[at] == history, self.backoff[at], 1.0)
        out = weight * lower
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.p[at], out)
        return out


def build(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray, ratio: np.ndarray, cutoff: int = CUTOFF, bits: int = NARROW) -> Part:
    """A part from all n-grams of its histories, sorted, with their counts and next lower order's probabilities."""
    histories, which = np.unique(keys >> np.uint64(bits), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(histories))
    kept = counts > cutoff
    weight = np.where(counts < len(ratio), ratio[np.minimum(counts, len(ratio) - 1)], 1.0) * counts
    mass = np.bincount(which[kept], weights=weight[kept], minlength=len(histories))
    total = np.where(mass >= total * (1 - 1e-12), total + 1, total)
    p = weight / total[which]
    below = np.bincount(which[kept], weights=lower[kept], minlength=len(histories))
    left = np.maximum(1 - below, 0)
    backoff = np.where(left > 1e-12, (1 - mass / total) / np.maximum(left, 1e-300), 0.0)
    # every word is kept: nothing is left to go to
    p = np.where(left[which] > 1e-12, p, p / np.maximum(mass / total, 1e-300)[which])
    return Part(keys[kept], p[kept], histories, backoff, bits)


def _lower_of(sent: list, n: int, total: int) -> np.ndarray:
    """Probabilities of order ``n - 1`` of the n-grams that were sent."""
    lower = np.concatenate([x[3] for x in sent])
    return (lower + 1.0) / total if n == 2 else lower.view(np.float32).astype(np.float64)


class Shares:
    """All n-grams of some histories, sorted, each with what its probability is made of once the discounts are known.

    ``kind``: the count up to ``most + 1``; with ``CLOSED`` added where every word is kept after the history, or ``ABSENT`` for an n-gram that isn't kept.
    """

    CLOSED, ABSENT = 64, 128
    __slots__ = ("count", "history", "kind", "left", "lower", "sums", "total")

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: np.ndarray, cutoff: int, bits: int, most: int = DISCOUNTED):
        histories, self.history = np.unique(keys >> np.uint64(bits), return_inverse=True)
        m, class_, kept = len(histories), np.minimum(counts, most + 1), counts > cutoff
        total = np.bincount(self.history, weights=counts, minlength=m)
        #: Counts of each class among what a history keeps.
        self.sums = np.bincount(self.history[kept] * (most + 2) + class_[kept], weights=counts[kept], minlength=m * (most + 2)).reshape(m, most + 2)
        # nothing is discounted where no kept count is low: such a history counts one more
        self.total = np.where(self.sums[:, most + 1] >= total, total + 1, total)
        self.left = np.maximum(1 - np.bincount(self.history[kept], weights=lower[kept], minlength=m), 0)
        closed = (self.left <= 1e-12)[self.history]
        self.kind = np.where(kept, np.where(closed, class_ + self.CLOSED, class_), self.ABSENT).astype(np.uint8)
        self.count, self.lower = counts, lower

    def answer(self, at: np.ndarray, lower: np.ndarray) -> tuple[bytes, bytes | None]:
        """What a batch is told of its n-grams: kinds and shares; and, for those that take more, the rest."""
        h, kind = self.history[at], self.kind[at]
        share = (self.count[at] / self.total[h]).astype(np.float32)
        rare = np.flatnonzero(kind >= self.CLOSED)
        more = np.column_stack([self.count[at][rare], lower[rare], self.left[h[rare]], self.total[h[rare]], self.sums[h[rare]]]).astype(np.float64).tobytes() if len(rare) else None
        return _loose(kind, share.view(np.uint32)), more


def probabilities(kind: np.ndarray, share: np.ndarray, more: bytes | None, ratio: np.ndarray) -> np.ndarray:
    """Katz probabilities from a partition's answer and the discounts."""
    weight = np.append(ratio, 1.0)  # of each class of counts, the last one being of all higher ones
    p = weight[np.minimum(kind & (Shares.CLOSED - 1), len(weight) - 1)] * share
    rare = np.flatnonzero(kind >= Shares.CLOSED)
    if len(rare):
        count, lower, left, total, *sums = np.frombuffer(more, np.float64).reshape(len(rare), -1).T
        mass = sum(weight[r] * s for r, s in enumerate(sums) if r)
        open_ = left > 1e-12
        backed = np.where(open_, (1 - mass / total) / np.where(open_, left, 1), 0.0) * lower
        alone = weight[kind[rare] & (Shares.CLOSED - 1)] * count / np.maximum(mass, 1e-300)
        p[rare] = np.where(kind[rare] >= Shares.ABSENT, backed, alone)
    return p


def _tell(n: int, cutoff: int, total: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """One partition's answers to all batches, and its counts of counts."""
        trim()
        rows = table.to_pylist()
        sent = [unpack(r["blob"], 4) for r in rows]
        every, counts = _keys(sent, bits)
        lower = _lower_of(sent, n, total)
        keys, first, which, _ = distinct(every)
        merged = np.bincount(which, weights=counts).astype(np.int64)
        shares = Shares(keys, merged, lower[first], cutoff, bits)
        slot = rows[0]["slot"]
        seen = np.bincount(np.minimum(merged, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
        out = [(slot, None, None, None, seen.astype(np.int64).tobytes())]
        ends = np.cumsum([len(x[0]) for x in sent])
        for r, x, e in zip(rows, sent, ends, strict=True):
            own = slice(e - len(x[0]), e)
            out.append((slot, r["batch"], *shares.answer(which[own], lower[own]), None))
        return pa.Table.from_batches([_batch(_TOLD, out)])

    return run


def _part(n: int, ratio: np.ndarray, cutoff: int, total: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """One partition's part of the model."""
        trim()
        rows = table.to_pylist()
        sent = [unpack(r["blob"], 4) for r in rows]
        every, counts = _keys(sent, bits)
        keys, first = np.unique(every, return_index=True)
        part = build(keys, _merged(every, counts)[1], _lower_of(sent, n, total)[first], ratio, cutoff, bits)
        return pa.Table.from_batches([_batch(_PARTS, [(rows[0]["slot"], pack(part.keys, part.p.view(np.uint64)), pack(part.histories, part.backoff.view(np.uint64)))])])

    return run


def _receive(n: int, slots: int, bits: int, last: bool, ratio: np.ndarray):
    """Documents get the logarithms of the probabilities that no higher order replaces."""

    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        row = texts.to_pylist()[0]
        first, end, ids, valid, sums = unpack(row["documents"], 5)
        answers = [np.zeros(0, np.float32)]
        for r in sorted(told.to_pylist(), key=lambda r: r["slot"]):
            kind, share = unpack(r["blob"], 3)[1:]
            answers.append(probabilities(kind, share.view(np.float32), r["more"], ratio).astype(np.float32))
        own = np.concatenate(answers)
        grams = Grams(row, n, slots, bits)
        p = np.ones(int(end.max(initial=0)))
        p[grams.at] = own[grams.rank]
        sums = sums.view(np.float64) + _sums(np.log(p), first, end if last else np.minimum(end, first + np.uint64(n)))
        if last:
            return _scored(first, end, ids, valid, sums)
        return pa.Table.from_batches([_batch(_TEXTS, [(row["batch"], pack(first, end, ids, valid, sums.view(np.uint64)), row["words"], row["counts"], _loose(own.view(np.uint32)))])])

    return run


def _let_go(spark, *tables: DataFrame) -> None:
    """Shuffle files of passes that are over go when the driver collects its garbage, a moment later; ``tables`` in the shared folder go at once."""
    for table in tables:
        if files := table.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def trained_and_scored(docs: DataFrame, order: int = ORDER, words: int | None = None, cutoff: int = CUTOFF, keep: bool = True) -> tuple[DataFrame, Vocabulary, dict[int, DataFrame]]:
    """Scores of all documents, the vocabulary, and by order the model's packed parts ``(slot, blob, histories)``, made when they are asked for.

    Without ``keep``, the batches from which lower orders' parts are made go when they have served.
    """
    if not 1 <= order <= 4 or words is not None and words < 1:
        raise ValueError("order must be 1 to 4, words at least 1")
    spark = docs.sparkSession
    source = texts_of(docs)
    slots = exchange_parts(source)
    vocabulary_ = vocabulary(source, words)
    total, bits = vocabulary_.total, vocabulary_.bits
    unknown = 0 if words is None else vocabulary_.unknown
    seen = source.mapInArrow(_texts_seen, _sql(_TEXTS))
    numbers = vocabulary_.table.where("batch is not null").select("slot", "batch", "blob")
    texts = seen.groupBy("batch").cogroup(numbers.groupBy("batch")).applyInArrow(_numbered(total, unknown, order == 1), _sql(_SCORES if order == 1 else _TEXTS))
    if order > 1:
        texts = written(texts)
        if not keep:
            del seen, numbers
            _let_go(spark, vocabulary_.table)
    model: dict[int, DataFrame] = {}
    for n in range(2, order + 1):
        last = n == order
        sent = texts.mapInArrow(_send(n, slots, bits), _sql(_SENT)).groupBy("slot")
        told = written(sent.applyInArrow(_tell(n, cutoff, total, bits), _sql(_TOLD)))
        _let_go(spark)
        counted = told.where("batch is null").select("counts").mapInArrow(_counted, "r long, n long")
        ratio = discounts({r.r: r.n for r in counted.groupBy("r").agg(F.sum("n").alias("n")).collect()})
        if keep:
            model[n] = sent.applyInArrow(_part(n, ratio, cutoff, total, bits), _sql(_PARTS))
        answers = told.where("batch is not null").select("slot", "batch", "blob", "more")
        asked, before = texts.select("batch", "documents", "words", "counts"), texts
        texts = asked.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_receive(n, slots, bits, last, ratio), _sql(_SCORES if last else _TEXTS))
        if not last:
            texts = written(texts)
            if not keep:
                _let_go(spark, before, told)
    return texts, vocabulary_, model


def scores(docs: DataFrame, order: int = ORDER, words: int | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """``(doc_id, n_tokens, log_probability, perplexity)`` of every row of ``docs`` under the model of all of them (natural logarithms)."""
    scored, _, _ = trained_and_scored(docs, order, words, cutoff, keep=False)
    return scored.withColumn("perplexity", F.exp(-F.col("log_probability") / F.col("n_tokens")))


def model_parts(model: dict[int, DataFrame], slots: int) -> dict[int, dict[int, Part]]:
    """Parts of a small model on the driver, for tests and inspection."""
    return {n: {r.slot: Part(*(a.view(np.float64) if k else a for k, a in enumerate(unpack(bytes(r.blob), 2))), *(a.view(np.float64) if k else a for k, a in enumerate(unpack(bytes(r.histories), 2)))) for r in table.collect()} for n, table in model.items()}
