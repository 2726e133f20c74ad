"""Passages that repeat across documents, by a distributed sort of suffixes.

A suffix begins at each word that has at least ``length - 1`` words behind it in its document. Two documents share a passage of
``length`` words where two suffixes agree in their first ``length`` words, and in suffix order such suffixes are neighbours. Words
are ordered by their hash, so that a suffix's *leading words* give its place:

* Splitters are quantiles of the leading words of suffixes sampled from all documents; they cut the suffix order into buckets.
* Each suffix goes to its bucket as two leading words (16 bits of each), a 48-bit fingerprint of its first ``length`` words, its
  ``doc_id`` and its place, packed by batch of documents; texts are never shuffled.
* A bucket is sorted by multikey quicksort: by the leading words first, then, inside the runs that are still tied only, by the rest.
* Splitters that fall inside one hot passage are equal, and its suffixes are spread over all buckets between them. Such a run goes on
  across bucket boundaries: what its parts have found is compared across them before its holders are told.

A run is a repeat if it has suffixes of at least two documents. The occurrence of the least ``doc_id`` is the *source*; the others are
copies. Overlapping repeats make one span.

Null ``doc_id`` or text, and texts of fewer than ``length`` words, hold no repeat. Passages that repeat inside one document only don't
count. Rows of the same ``doc_id`` are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.packs import WordBatch, grouped, pack, trim, unpack, word_batches
from factloom.llm.shared import bounded, parts, pieces, small, texts_of, written

LENGTH = 50
#: Splitters come from one suffix in so many, of one document in so many; they bound the buckets' sizes, never results.
SAMPLE_SUFFIXES, SAMPLE_DOCUMENTS = 64, 64

_BLOB = pa.schema([("slot", pa.int32()), ("blob", pa.binary())])
_FOUND = pa.schema([("bin", pa.int32()), ("lead", pa.int64()), ("rest", pa.int64()), ("least", pa.int64()), ("several", pa.bool_()), ("blob", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("copy", pa.bool_())])
_SIGN = np.uint64(1 << 63)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def suffixes(batch: WordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the batch at which suffixes begin, the documents, leading words and fingerprints (48 bits)."""
    at, owner = tokens.windows(batch.as_words(), length)
    keep = batch.valid[owner]
    at, owner = at[keep], owner[keep]
    if not len(at):
        return at, owner, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    head = batch.hash >> np.uint64(48)
    second = head[at + 1] if length > 1 else np.zeros(len(at), np.uint64)
    return at, owner, head[at] << np.uint64(16) | second, tokens.ngram_hash(batch.hash, at, length) >> np.uint64(16)


def _key(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What splitters compare: the leading words and the first bits of what follows."""
    return lead << np.uint64(32) | rest >> np.uint64(16)


def multikey_sort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by the columns: quicksort by the first, then by the next one only inside runs that are tied so far."""
    order = np.argsort(columns[0])
    first = columns[0][order]
    tied = np.arange(len(order))
    run = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if len(order) else np.zeros(0, np.int64)
    for column in columns[1:]:
        _, n = grouped(run)
        inside = np.repeat(n > 1, n)
        tied, run = tied[inside], run[inside]
        if not len(tied):
            break
        value = column[order[tied]]
        again = np.lexsort((value, run))  # a run is a range of the order, and stays one
        order[tied] = order[tied[again]]
        value, run = value[again], run[again]
        run = np.cumsum(np.concatenate([[0], (run[1:] != run[:-1]) | (value[1:] != value[:-1])]))
    return order


def _sample(length: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_batches(batches):
            at, _, lead, rest = suffixes(batch, length)
            # by place, not by content: a hot passage must show its weight
            chosen = tokens.mix(at.astype(np.uint64) + np.uint64(batch.number)) % np.uint64(every) == 0
            # signed order as unsigned
            yield pa.RecordBatch.from_arrays([pa.array((_key(lead, rest)[chosen] ^ _SIGN).view(np.int64))], names=["key"])

    return run


def splitters(docs: DataFrame, length: int, buckets: int) -> np.ndarray:
    """At most ``buckets - 1`` keys that cut sampled suffixes into equal parts; equal ones if a passage is hot. Empty if nothing was sampled."""
    if buckets < 2:
        return np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCUMENTS)) == 0)
    sampled = some.mapInArrow(_sample(length, SAMPLE_SUFFIXES), "key long")
    cut = sampled.agg(F.percentile_approx("key", F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 20 * buckets).alias("cut")).first().cut
    return np.array(cut or [], dtype=np.int64).view(np.uint64) ^ _SIGN


def _scatter(length: int, cut: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_batches(batches):
            at, owner, lead, rest = suffixes(batch, length)
            if not len(at):
                continue
            key = _key(lead, rest)
            low, slot = np.searchsorted(cut, key, side="left"), np.searchsorted(cut, key, side="right")
            hot = slot - low > 1  # equal to several splitters: to any of the buckets between them
            slot[hot] = low[hot] + 1 + (tokens.mix(at[hot].astype(np.uint64) + np.uint64(batch.number)) % (slot - low)[hot].astype(np.uint64)).astype(np.int64)
            order = multikey_sort([slot.astype(np.uint64) << np.uint64(32) | lead, rest])
            place = (at - batch.first[owner]).astype(np.uint32)[order]
            doc, slot, lead, rest = batch.ids[owner[order]].view(np.uint64), slot[order], lead[order].astype(np.uint32), rest[order]
            rows = [(int(slot[b]), pack(lead[b : b + m], (rest[b : b + m] >> np.uint64(32)).astype(np.uint16), rest[b : b + m].astype(np.uint32), doc[b : b + m], place[b : b + m])) for b, m in zip(*grouped(slot), strict=True)]
            yield _batch(_BLOB, rows)

    return run


def _told(doc: np.ndarray, place: np.ndarray, copy: np.ndarray, bins: int) -> Iterator[tuple[int, bytes]]:
    target = (tokens.mix(doc.view(np.uint64)) % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((place, doc, target))
    target, doc, place, copy = target[order], doc[order], place[order], copy[order]
    for b, m in zip(*grouped(target), strict=True):
        yield int(target[b]), pack(doc[b : b + m].view(np.uint64), place[b : b + m].astype(np.uint32), copy[b : b + m].astype(np.uint8))


def _sorted_bucket(cut: np.ndarray, bins: int):
    hot_keys = np.unique(cut[1:][cut[1:] == cut[:-1]]) if len(cut) else cut

    def run(table: pa.Table) -> pa.Table:
        trim()
        parts_ = [unpack(blob, 5) for blob in table.column("blob").to_pylist()]
        lead, high, low, doc, place = (np.concatenate([x[k] for x in parts_]) for k in range(5))
        del parts_
        rest = high.astype(np.uint64) << np.uint64(32) | low
        lead = lead.astype(np.uint64)
        order = multikey_sort([lead, rest])
        lead, rest, doc, place = lead[order], rest[order], doc[order].view(np.int64), place[order]
        run_ = np.cumsum(np.concatenate([[0], (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])]))
        at, n = grouped(run_)
        least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        open_ = np.isin(_key(lead[at], rest[at]), hot_keys)
        rows = []
        shut = np.repeat((least != most) & ~open_, n)
        source = np.repeat(least, n)
        rows += [(b, None, None, None, None, blob) for b, blob in _told(doc[shut], place[shut], doc[shut] != source[shut], bins)]
        for k in np.flatnonzero(open_):  # few: hot passages that lie across boundaries
            members = slice(at[k], at[k] + n[k])
            by = np.lexsort((place[members], doc[members]))
            rows.append((None, int(lead[at[k]]), int(rest[at[k]]), int(least[k]), bool(least[k] != most[k]), pack(doc[members][by].view(np.uint64), place[members][by])))
        return pa.Table.from_batches([_batch(_FOUND, rows)])

    return run


def _across(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for least, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc, place = unpack(blob, 2)
                doc = doc.view(np.int64)
                yield _batch(pa.schema([("bin", pa.int32()), ("blob", pa.binary())]), list(_told(doc, place, doc != least, bins)))

    return run


def _union(length: int):
    def run(table: pa.Table) -> pa.Table:
        parts_ = [unpack(blob, 3) for blob in table.column("blob").to_pylist()]
        doc, place, copy = (np.concatenate([x[k] for x in parts_]) for k in range(3))
        order = np.lexsort((place, doc, copy))
        doc, place, copy = doc[order].view(np.int64), place[order].astype(np.int64), copy[order]
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (place[1:] > place[:-1] + length)])
        at = np.flatnonzero(fresh)
        end = np.append(at[1:], len(doc)) - 1
        return pa.Table.from_arrays([pa.array(doc[at]), pa.array(place[at].astype(np.int32)), pa.array((place[end] + length).astype(np.int32)), pa.array(copy[at] > 0)], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, start_word, end_word, copy)``: maximal spans, as word numbers from 0 with the end left out, of which each run of ``length``
    words also stands in another document. Spans of sources (``copy`` false: the occurrence of the least ``doc_id``) and of copies are
    given apart; where a text goes on from one kind to the other, the two may overlap by fewer than ``length`` words."""
    if length < 1:
        raise ValueError("length must be at least 1")
    spark = docs.sparkSession
    buckets = bins = 2 * parts(spark)
    source = texts_of(docs).where("doc_id is not null and text is not null")
    cut = splitters(source, length, buckets)
    scattered = source.mapInArrow(_scatter(length, cut), _sql(_BLOB))
    found = written(scattered.groupBy("slot").applyInArrow(_sorted_bucket(cut, bins), _sql(_FOUND)))
    shut = found.where("bin is not null").select("bin", "blob")
    opened = found.where("bin is null")
    across = opened.groupBy("lead", "rest").agg(F.min("least").alias("first"), (F.max("several") | (F.min("least") != F.max("least"))).alias("repeats")).where("repeats")
    told = opened.join(across, ["lead", "rest"]).select("first", "blob").mapInArrow(_across(bins), "bin int, blob binary")
    return shut.unionAll(told).groupBy("bin").applyInArrow(_union(length), _sql(_SPANS))


def _cut_out(schema: pa.Schema, text_at: int, count_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            spans = batch.column(batch.num_columns - 1)
            held = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, dtype=bool)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            if len(held):
                texts = columns[text_at].to_pylist()
                counts = columns[count_at].to_pylist() if count_at is not None else None
                w = tokens.words(columns[text_at].take(pa.array(held)))
                for k, d in enumerate(held):
                    raw, first = texts[d].encode(), int(w.first[k])
                    left, at = [], 0
                    for span in spans[int(d)].as_py():
                        left.append(raw[at : int(w.start[first + span["start_word"]])])
                        at = int(w.end[first + span["end_word"] - 1])
                    left.append(raw[at:])
                    texts[d] = b"".join(left).decode().strip()
                    keep[d] = bool(texts[d])
                    if counts:
                        counts[d] = len(texts[d])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if counts:
                    columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema).filter(pa.array(keep))

    return run


def without_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with copied passages cut out of ``text`` (sources stay) and ``n_chars``, where there is such a column, set to what is left.

    A document of which nothing is left but white space goes; all others, nulls and short ones too, stay as they are.
    """
    bounded(docs.sparkSession)
    spans = repeated_spans(docs, length).where("copy").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__factloom_spans")).withColumnRenamed("doc_id", "__factloom_doc")
    spans = written(spans)
    joined = docs.join(small(spans), F.col("doc_id") == F.col("__factloom_doc"), "left").drop("__factloom_doc")
    names = docs.columns
    return joined.mapInArrow(_cut_out(names, names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)


def brute_spans(rows: list[tuple[int, list[str]]], length: int = LENGTH) -> set[tuple[int, int, int, bool]]:
    """Spans of ``(doc_id, words)`` by a table of all windows, for tests."""
    holders: dict[tuple, set[int]] = {}
    for doc, words in rows:
        for k in range(len(words) - length + 1):
            holders.setdefault(tuple(words[k : k + length]), set()).add(doc)
    out = set()
    for copy in (False, True):
        marked: dict[int, list[int]] = {}
        for doc, words in rows:
            marked.setdefault(doc, []).extend(k for k in range(len(words) - length + 1) if len(h := holders[tuple(words[k : k + length])]) > 1 and (doc != min(h)) == copy)
        for doc, places in marked.items():
            begin = end = None
            for k in sorted(places):
                if end is None or k > end:
                    if end is not None:
                        out.add((doc, begin, end, copy))
                    begin = k
                end = k + length
            if end is not None:
                out.add((doc, begin, end, copy))
    return out
