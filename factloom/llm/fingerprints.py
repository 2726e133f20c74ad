"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

Each paragraph's digest is hashed into one cell of each of ``HASHES`` parts of a table; a cell holds the number of digests, their xor and the
xor of their checks. The tables of two versions of a document, subtracted cell by cell, hold just the digests in which the versions differ.
Peeling takes a cell with one digest, gives it out as added or removed, takes it off its other cells, and goes on until nothing is left. A
table too small for the difference gets stuck; that pair of versions is then tried again with tables ``GROWTH`` times larger, until none is left. Only
tables are brought together, never lists of digests.

*Versions.* Each long paragraph (at least ``LONG_CHARS`` characters) of a document names the document before it, in order of ``doc_id``, that has the same one; the
document that is named by most paragraphs (of equal ones, the last one) is the version before, provided the two have at least half of the paragraphs of the smaller one in
common. Holders of a paragraph are sorted across partitions, so that one that very many documents have, such as a license line, is nobody's burden.

A paragraph is a line without the spaces around it; blank lines are none. A digest is 60 bits of the MD5 of the paragraph; the second and later
occurrences of a paragraph in a document have digests of their own.

Null ``doc_id``: never a version. Null or blank text, or one without a long paragraph: no version before it, nulls for it and for what was added and removed. Rows of one
``doc_id`` with different paragraphs are versions of each other, in the order of their digests' hash; equal rows are one version, and each gets the same result. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.shared import exchange_parts, small, texts_of, written

HASHES, CELLS, GROWTH = 3, 24, 4
LONG_CHARS = 64


def digests(text: str) -> tuple[list[int], list[int]]:
    """Digests of a text's paragraphs, in order, and those of its distinct long ones."""
    out, long, seen = [], [], {}
    for line in text.split("\n"):
        paragraph = line.strip(" ")
        if not paragraph:
            continue
        again = seen[paragraph] = seen.get(paragraph, 0) + 1
        raw = paragraph if again == 1 else f"{paragraph}\n{again}"
        digest = int(hashlib.md5(raw.encode(), usedforsecurity=False).hexdigest()[:15], 16)
        out.append(digest)
        if again == 1 and len(paragraph) >= LONG_CHARS:
            long.append(digest)
    return out, long


def cells_of(keys: np.ndarray, cells: int, attempt: int) -> np.ndarray:
    """The cells of each digest, one in each part of the table. Another attempt hashes otherwise."""
    part = cells // HASHES
    salted = [tokens.mix(keys + np.uint64((attempt * HASHES + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(HASHES)]
    return np.stack([(h % np.uint64(part)).astype(np.int64) + k * part for k, h in enumerate(salted)])


def check_of(keys: np.ndarray) -> np.ndarray:
    return tokens.mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def sketch(keys: np.ndarray, cells: int, attempt: int = 0) -> np.ndarray:
    """``cells`` rows of number, xor of digests and xor of checks."""
    table = np.zeros((3, cells), dtype=np.uint64)
    keys = keys.astype(np.uint64)
    at = cells_of(keys, cells, attempt)
    np.add.at(table[0], at, np.uint64(1))
    np.bitwise_xor.at(table[1], at, keys)
    np.bitwise_xor.at(table[2], at, check_of(keys))
    return table


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a ^ b
    out[0] = a[0] - b[0]
    return out


def peel(table: np.ndarray, attempt: int = 0) -> tuple[list[int], list[int]] | None:
    """Digests that only the first and only the second version has; None if the table is too small for them."""
    table, cells = table.copy(), table.shape[1]
    only: dict[int, list[int]] = {1: [], -1: []}
    one, minus = np.uint64(1), np.uint64((1 << 64) - 1)
    while True:
        pure = np.flatnonzero(((table[0] == one) | (table[0] == minus)) & (check_of(table[1]) == table[2]))
        if not len(pure):
            return None if table.any() else (sorted(only[1]), sorted(only[-1]))
        keys, first = np.unique(table[1, pure], return_index=True)
        signs = table[0, pure[first]]
        at = cells_of(keys, cells, attempt)
        for k, key in enumerate(keys):
            only[1 if signs[k] == one else -1].append(int(key))
        np.subtract.at(table[0], at, np.broadcast_to(signs, at.shape))
        np.bitwise_xor.at(table[1], at, np.broadcast_to(keys, at.shape))
        np.bitwise_xor.at(table[2], at, np.broadcast_to(check_of(keys), at.shape))


_LISTS = pa.list_(pa.int64())


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [digests(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([long for _, long in rows], _LISTS), pa.array([d for d, _ in rows], _LISTS)], names=["doc_id", "long", "digests"])


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, digest, doc_id, row)`` in order: each with the row before it if that has the same digest. The first and the last one of a part are given too, with ``edge`` 0 and 1."""
    part, last, names = None, None, ["part", "edge", "digest", "doc_id", "row", "before_id", "before"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    for batch in batches:
        part_, digest, doc, row = (c.to_numpy() for c in batch.columns)
        if not len(row):
            continue
        part, head = int(part_[0]), last is None
        if last is not None:
            digest, doc, row = (np.concatenate([[x], y]) for x, y in zip(last, (digest, doc, row), strict=True))
        same = np.flatnonzero(digest[1:] == digest[:-1]) + 1
        none = np.full(len(same), -1, np.int32)
        columns = [none, none, digest[same], doc[same], row[same], doc[same - 1], row[same - 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((part, 0, digest[0], doc[0], row[0], None, None), kinds, strict=True)], names=names)
        last = digest[-1], doc[-1], row[-1]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((part, 1, *last, None, None), kinds, strict=True)], names=names)


def predecessors(holders: DataFrame, parts: int) -> DataFrame:
    """``(row, before_id, before)`` of distinct ``holders (digest, doc_id, row)``: for each row and digest of it, the row before it, by ``doc_id``, that has the digest too.

    Like a lag over the holders of a digest, but a digest's holders may lie in many partitions: these are ranges of all rows, and where a range goes on with the digest of the one
    before, that one's last row (a row a range, on the driver) is the first one's predecessor.
    """
    ranged = holders.repartitionByRange(parts, "digest", "doc_id", "row").sortWithinPartitions("digest", "doc_id", "row")
    found = written(ranged.select(F.spark_partition_id().alias("part"), "digest", "doc_id", "row").mapInArrow(_before, "part int, edge int, digest long, doc_id long, row long, before_id long, before long"))
    edges = sorted((tuple(r) for r in found.where("edge >= 0").select("part", "edge", "digest", "doc_id", "row").collect()))
    joints = [(now[4], then[3], then[4]) for then, now in zip(edges, edges[1:], strict=False) if then[1] == 1 and now[1] == 0 and then[2] == now[2]]
    inside = found.where("edge < 0").select("row", "before_id", "before")
    return inside.unionAll(holders.sparkSession.createDataFrame(joints, "row long, before_id long, before long"))


def _sketched(cells: int, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [zlib.compress(sketch(np.array(d, np.uint64), cells, attempt).tobytes(), 1) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.binary())], names=["row", "sketch"])

    return run


def _compared(cells: int, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Differences of two tables, where they can be told, and whether the two have half of the smaller one's paragraphs in common."""
        read = lambda blob: np.frombuffer(zlib.decompress(blob), np.uint64).reshape(3, cells)
        for batch in batches:
            added, removed, done, alike = [], [], [], []
            for now, before in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                now, before = read(now), read(before)
                found = peel(subtract(now, before), attempt)
                n, m = (int(x[0].sum()) // HASHES for x in (now, before))
                done.append(found is not None)
                alike.append(found is not None and 2 * (n - len(found[0])) >= min(n, m))
                added.append(found and found[0])
                removed.append(found and found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(added, _LISTS), pa.array(removed, _LISTS), pa.array(done, pa.bool_()), pa.array(alike, pa.bool_())], names=["row", "before", "before_id", "added", "removed", "done", "alike"])

    return run


_PAIR = "row long, before long, before_id long, added array<long>, removed array<long>, done boolean, alike boolean"


def fingerprint_sketches(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """``(doc_id, cells array<struct<n, digest, check>>)``: each document's table, to be kept beside it and subtracted from another one's."""

    def run(batches):
        for batch in batches:
            tables = [sketch(np.array(digests(t or "")[0], np.uint64), cells).view(np.int64) for t in batch.column(1).to_pylist()]
            rows = [[{"n": int(n), "digest": int(d), "check": int(c)} for n, d, c in t.T] for t in tables]
            kind = pa.list_(pa.struct([("n", pa.int64()), ("digest", pa.int64()), ("check", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "cells"])

    return texts_of(docs).mapInArrow(run, "doc_id long, cells array<struct<n: long, digest: long, check: long>>")


def version_changes(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """``(doc_id, n_paragraphs, version_of, added, removed)`` of every row: the version before it, and the digests of paragraphs that came and went, sorted."""
    if cells < HASHES or cells % HASHES:
        raise ValueError(f"cells must be a multiple of {HASHES}")
    source = texts_of(docs)
    digested = source.mapInArrow(_digested, "doc_id long, long array<long>, digests array<long>")
    rows = written(digested.withColumn("row", F.xxhash64("doc_id", "digests")))
    holders = rows.where("doc_id is not null").select(F.explode("long").alias("digest"), "doc_id", "row").distinct()
    named = predecessors(holders, exchange_parts(source)).groupBy("row", "before").agg(F.count("*").alias("n"), F.first("before_id").alias("before_id"))
    best = named.groupBy("row").agg(F.max(F.struct("n", "before_id", "before")).alias("best"))
    pending = written(best.select("row", "best.before", "best.before_id"))
    found, attempt = [], 0
    while True:
        wanted = small(pending.select(F.col("row").alias("wanted")).unionAll(pending.select("before")).distinct())
        lists = rows.join(wanted, F.col("row") == F.col("wanted"), "left_semi").select("row", "digests").dropDuplicates(["row"])
        tables = lists.mapInArrow(_sketched(cells, attempt), "row long, sketch binary")
        both = pending.join(tables.withColumnRenamed("sketch", "now"), "row").join(tables.select(F.col("row").alias("before"), F.col("sketch").alias("then")), "before")
        tried = written(both.select("row", "before", "before_id", "now", "then").mapInArrow(_compared(cells, attempt), _PAIR))
        found.append(tried.where("alike").select(F.col("row").alias("of"), F.col("before_id").alias("version_of"), "added", "removed"))
        pending = tried.where("not done").select("row", "before", "before_id")
        if pending.isEmpty():
            break
        cells, attempt = cells * GROWTH, attempt + 1
    changes = reduce(DataFrame.unionAll, found)
    # a null id has no version, whatever its row's hash
    told = rows.join(small(changes), F.col("row") == F.col("of"), "left")
    return told.select("doc_id", F.size("digests").alias("n_paragraphs"), "version_of", "added", "removed")
