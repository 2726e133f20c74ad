"""N-gram Jaccard self-join of documents by vertical partitioning.

The n-grams of all documents have one global order, by the binary order of magnitude of the number of documents that hold them and
then by hash. That order is cut into fragments. In each fragment, what pairs of documents share inside it is counted apart, and a sum per
pair over the fragments gives the overlap. Three filters that lose nothing come before the pairs:

* A document of which fewer than ``ceil(t * size)`` n-grams occur in any other document has no partner, and leaves after the first
  pass, in which n-grams' holders are counted from packed hashes, with one shuffle.
* Documents with equal sets of n-grams are one *class*; only one member of it is compared on, and stands for all.
* The *prefix* of a set is its ``size - ceil(t * size) + 1`` least n-grams in the global order (rare ones come first). Partners of sizes a >= b share
  ``ceil(t / (1 + t) * (a + b)) - ceil(t * a) + 1`` n-grams or more inside both prefixes, as what else they share lies behind the prefix that ends first (``least_shared``).
  N-grams with fewer than ``HOT`` holders are counted pair by pair in each fragment, partial overlaps are summed, and pairs that reach that bound are tied; so chance
  meetings tie nothing. Holders of a more frequent n-gram in their prefixes are tied to the least of them, without pairs: these are texts that mostly consist of what many others hold.
  Classes are compared inside the components of these ties only.

Components larger than ``MEMBERS`` classes or ``TILE_BYTES`` are cut into blocks, and each two blocks are a *tile* of its own: a hot group
is spread over as many tasks as it has tiles, no pair is ever shuffled, and a tile gives one row per class for links and connections.

An n-gram is ``n`` consecutive words (see ``tokens``); a text of fewer words, but at least one, has the hash of all its words as its only n-gram.
N-grams are known by 64 bits of their hash: two texts could only be linked falsely by several clashes at once. Each row is a text of its own, also
where rows share a ``doc_id``. Null ``doc_id`` or text, and texts without a word, have no partner. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import tokens
from factloom.llm.components import components
from factloom.llm.packs import grouped, pack, trim, unpack, word_batches
from factloom.llm.shared import exchange_parts, parts, small, texts_of, without, written

#: Indexes of near copies of the synthetic documents form one hump from 0.55 up, with a valley at 0.45 to 0.55 between it and unrelated texts.
N, THRESHOLD = 3, 0.55
#: Vertical fragments in which partial overlaps are counted, at least; more where a fragment would not fit into ``BLOCK`` cells.
FRAGMENTS = 8
#: Cells of a block of the pair matrix; only bounds memory.
BLOCK = 1 << 20
#: Classes, and packed bytes of their n-grams, of one block of a large component; they bound a task's work, never results.
MEMBERS, TILE_BYTES = 1024, 8 << 20
#: Order of magnitude (see ``gram_class``) from which holders of an n-gram are tied to one of them in place of being paired: 16 holders or more.
HOT = 4

_PACKED = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("set_hash", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("ranks", T.BinaryType())])
_LINKS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("near", pa.int64()), ("links", pa.int64())])
_PAIRS = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("jaccard", pa.float64())])


def _rows(schema: T.StructType, columns: list) -> pa.RecordBatch:
    kinds = {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def need(size, threshold: float):
    """Least overlap with any partner of a set of so many; ``ceil`` guarded against the last bit of the product."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def gram_sets(batch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each document, sorted by n-gram, with their documents; and size and hash of each document's set."""
    count = np.diff(batch.first)
    grams, owner = tokens.ngrams(batch.as_words(), n)
    for short in range(1, n):
        docs = np.flatnonzero(count == short)
        if len(docs):
            grams = np.concatenate([grams, tokens.ngram_hash(batch.hash, batch.first[docs], short)])
            owner = np.concatenate([owner, docs])
    keep = batch.valid[owner]
    grams, owner = grams[keep], owner[keep]
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    if len(grams):
        fresh = np.ones(len(grams), dtype=bool)
        # ties of the stable sort are in document order but for the short texts, which have one n-gram each
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[fresh], owner[fresh]
    size = np.bincount(owner, minlength=len(count))
    mixed = tokens.mix(grams + np.uint64(1))
    total = [np.bincount(owner, weights=((mixed >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.float64), minlength=len(count)).astype(np.uint64) for s in (0, 21, 42)]
    return grams, owner, size, tokens.mix(total[0] ^ tokens.mix(total[1] ^ tokens.mix(total[2] + size.astype(np.uint64))))


def gram_class(holders: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(holders)).astype(np.uint8)


def _cut(n: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_batches(batches):
            grams, owner, size, set_hash = gram_sets(batch, n)
            slot = (grams >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
            at = np.searchsorted(slot, np.arange(slots + 1))
            has = np.flatnonzero(size)
            if not len(has):
                continue
            rows = [(s, batch.number, 0, pack(grams[i:j], owner[i:j].astype(np.uint32))) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            rows.append((batch.number % slots, batch.number, 1, pack(has.astype(np.uint32), batch.ids[has].view(np.uint64), size[has].astype(np.uint32), set_hash[has])))
            yield _rows(_PACKED, list(zip(*rows, strict=True)))

    return run


def _count(table: pa.Table) -> pa.Table:
    """One fragment of the hash order: which n-grams have two holders or more, told back to the batches that hold them."""
    trim()
    rows = table.to_pylist()
    out = [(r["slot"], r["batch"], 1, r["blob"]) for r in rows if r["kind"] == 1]
    own = [(r["batch"], r["slot"], *unpack(r["blob"], 2)) for r in rows if r["kind"] == 0]
    if own:
        grams = np.concatenate([x[2] for x in own])
        order = np.argsort(grams, kind="stable")
        at, length = grouped(grams[order])
        shared = np.zeros(len(grams), dtype=np.uint8)
        shared[order] = np.repeat(gram_class(length), length)
        base = 0
        for batch, slot, g, owner in own:
            c = shared[base : base + len(g)]
            base += len(g)
            if (keep := np.flatnonzero(c)).size:
                out.append((slot, batch, 0, pack(g[keep], owner[keep], c[keep])))
    return pa.Table.from_batches([_rows(_PACKED, list(zip(*out, strict=True)) if out else [[]] * 4)])


def _survivors(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Documents of one batch that may have a partner; ``ranks`` are their shared n-grams in the global order, with their orders of magnitude."""
        trim()
        rows = table.to_pylist()
        batch, (place, ids, size, set_hash) = next((r["batch"], unpack(r["blob"], 4)) for r in rows if r["kind"] == 1)
        own = [unpack(r["blob"], 3) for r in rows if r["kind"] == 0]
        out: list[list] = [[], [], [], [], []]
        if own:
            grams, owner, class_ = (np.concatenate([x[k] for x in own]) for k in range(3))
            order = np.lexsort((grams, class_, owner))
            grams, owner, class_ = grams[order], owner[order], class_[order]
            at = np.searchsorted(owner, place)
            shared = np.searchsorted(owner, place, side="right") - at
            for k in np.flatnonzero(shared >= need(size, threshold)):
                mine = slice(at[k], at[k] + shared[k])
                # a batch has fewer than 2 ** 20 texts with words
                for c, v in zip(out, ((batch << 20) + int(k), int(ids[k].view(np.int64)), int(set_hash[k].view(np.int64)), int(size[k]), pack(grams[mine], class_[mine])), strict=True):
                    c.append(v)
        return pa.Table.from_batches([_rows(_SETS, out)])

    return run


def least_shared(a, b, threshold: float):
    """N-grams, at least, that partners of sizes ``a`` and ``b`` share inside both prefixes."""
    whole = np.ceil((a + b) * (threshold / (1 + threshold)) - 1e-6).astype(np.int64)
    return np.maximum(1, whole - need(np.maximum(a, b), threshold) + 1)


def _prefixes(batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(node, size, grams, class_)`` of rows ``(node, size, ranks)``: what each one's prefix has of n-grams that others hold too."""
    for node, size, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        grams, class_ = unpack(blob, 2)
        alone = size - len(grams)  # n-grams of one holder come first in the order
        most = max(0, size - int(need(size, threshold)) + 1 - alone)
        yield node, size, grams[:most], class_[:most]


def _hot(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(gram, node)`` of frequent n-grams in prefixes."""
        for batch in batches:
            grams, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, _, own, class_ in _prefixes(batch, threshold):
                grams.append(own[class_ >= HOT].view(np.int64))
                nodes.append(np.full(len(grams[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(nodes))], names=["gram", "node"])

    return run


def _rare(threshold: float, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(slot, blob)``: the other n-grams of prefixes, by fragment, with their nodes and sizes.

        32 bits of the hash do inside a fragment: where two n-grams fall together, a pair is compared in vain."""
        for batch in batches:
            grams, nodes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
            for node, size, own, class_ in _prefixes(batch, threshold):
                grams.append(own[class_ < HOT])
                nodes.append(np.full(len(grams[-1]), node, dtype=np.uint64))
                sizes.append(np.full(len(grams[-1]), size, dtype=np.uint32))
            grams, nodes, sizes = (np.concatenate(x) for x in (grams, nodes, sizes))
            slot = (grams >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
            low = grams.astype(np.uint32)
            order = np.lexsort((low, slot))
            low, nodes, sizes = low[order], nodes[order], sizes[order]
            rows = [(int(slot[order[a]]), pack(low[a : a + m], nodes[a : a + m], sizes[a : a + m])) for a, m in zip(*grouped(slot[order]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slot", "blob"])

    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int32()), ("least", pa.int32())])


def _met(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Partial overlaps ``(a, b, shared, least)`` of prefixes in one fragment, of pairs whose sizes allow for a link; ``least`` is what must be reached in all."""
        trim()
        parts_ = [unpack(blob, 3) for blob in table.column("blob").to_pylist()]
        grams, nodes, sizes = (np.concatenate([x[k] for x in parts_]) for k in range(3))
        del parts_
        order = np.lexsort((nodes, grams))
        grams, nodes, sizes = grams[order], nodes[order], sizes[order].astype(np.int64)
        known, place = np.unique(nodes, return_inverse=True)
        size = np.zeros(len(known), dtype=np.int64)
        size[place] = sizes
        pairs = [np.zeros(0, np.uint64)]
        at = np.arange(len(grams))
        for far in range(1, len(grams)):  # holders are few: HOT bounds the rounds
            at = at[at + far < len(grams)]
            at = at[grams[at + far] == grams[at]]
            if not len(at):
                break
            fits = np.minimum(sizes[at], sizes[at + far]) >= threshold * np.maximum(sizes[at], sizes[at + far]) - 1e-9
            own = at[fits]
            pairs.append(place[own].astype(np.uint64) * np.uint64(len(known)) + place[own + far].astype(np.uint64))
        pairs, shared = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = (pairs // np.uint64(max(1, len(known)))).astype(np.int64), (pairs % np.uint64(max(1, len(known)))).astype(np.int64)
        keep = a != b  # a node meets itself where two of its n-grams fall together
        a, b, shared = a[keep], b[keep], shared[keep]
        return pa.table([known[a].view(np.int64), known[b].view(np.int64), shared.astype(np.int32), least_shared(size[a], size[b], threshold).astype(np.int32)], schema=_MET)

    return run


def overlaps(grams: np.ndarray, owner: np.ndarray, size: np.ndarray, threshold: float, block: int = BLOCK, class_: np.ndarray | None = None, left: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, shared)``, i < j, of sets given as n-grams and their owners; pairs whose sizes alone rule them out are left out.

    ``class_`` gives n-grams' orders of magnitude. ``size`` must not fall; with ``left``, the first so many sets are compared with the others only, and sizes must not fall in either part.
    """
    m = len(size)
    order = np.argsort(grams, kind="stable")
    at, length = grouped(grams[order])
    # columns in the global order, so that a range of them is a fragment of it
    place = np.empty(len(at), dtype=np.int64)
    place[np.arange(len(at)) if class_ is None else np.argsort(class_[order[at]], kind="stable")] = np.arange(len(at))
    several = np.zeros(len(at), dtype=bool)
    several[place] = length > 1
    column = np.empty(len(grams), dtype=np.int64)
    column[order] = np.repeat(place, length)
    column = np.where(several[column], (np.cumsum(several) - 1)[column], -1)
    owner, column = owner[column >= 0], column[column >= 0]
    wide = int(several.sum())
    if not wide:
        return
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    rows_end, other = (m, 0) if left is None else (left, left)
    rows_at_once = max(1, min(rows_end, block // m))
    cols_at_once = max(1, min(-(-wide // FRAGMENTS), block // m))
    cut = np.searchsorted(column, np.arange(0, wide + cols_at_once, cols_at_once))
    for top in range(0, rows_end, rows_at_once):
        low = min(rows_end, top + rows_at_once)
        # sets are in order of size, so that the partners of these rows lie in a range
        far = other + int(np.searchsorted(size[other:], size[low - 1] / threshold + 1e-9, side="right"))
        near = top if left is None else other + int(np.searchsorted(size[other:], size[top] * threshold - 1e-9, side="left"))
        if far <= near:
            continue
        total = np.zeros((low - top, far - near), dtype=np.float32)
        for k in range(len(cut) - 1):
            o, c = owner[cut[k] : cut[k + 1]], column[cut[k] : cut[k + 1]] - k * cols_at_once
            inside = (o >= near) & (o < far)
            above = (o >= top) & (o < low)
            if not (inside.any() and above.any()):
                continue
            held = np.zeros((far - near, cols_at_once), dtype=np.float32)
            held[o[inside] - near, c[inside]] = 1
            if left is None:
                mine = held[: low - top]
            else:
                mine = np.zeros((low - top, cols_at_once), dtype=np.float32)
                mine[o[above] - top, c[above]] = 1
            total += mine @ held.T  # the fragment's partial overlaps, added to those before
        i, j = np.nonzero(total)
        a, b = size[i + top], size[j + near]
        keep = (j + near > i + top) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
        i, j = i[keep], j[keep]
        yield i + top, j + near, total[i, j].astype(np.int32)


def connected(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """The least member of each one's connected component, of ``m`` numbers and edges between them."""
    label = np.arange(m)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _tiles(threshold: float, as_pairs: bool):
    def run(table: pa.Table) -> pa.Table:
        """Classes that are linked inside each tile of a bin: how many texts each is linked to and what it is connected with there; or the pairs."""
        trim()
        names = ("root", "low", "high", "part", "size", "node", "doc_id", "copies")
        root, low, high, part, size, node, doc, copies = (table.column(c).to_numpy() for c in names)
        ranks = table.column("ranks").to_pylist()
        order = np.lexsort((node, size, part, high, low, root))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (root, low, high)], axis=0)
        schema = _PAIRS if as_pairs else _LINKS
        out = [schema.empty_table()]
        at = np.flatnonzero(fresh)
        for a, m in zip(at, np.diff(np.append(at, len(order))), strict=True):
            own = order[a : a + m]
            left = None if low[own[0]] == high[own[0]] else int((part[own] == low[own[0]]).sum())
            if left is None and m == 1 or left is not None and not 0 < left < m:
                continue
            sets = [unpack(ranks[k], 2) for k in own]
            grams, class_ = (np.concatenate([x[k] for x in sets]) for k in range(2))
            owner = np.repeat(np.arange(m), [len(x[0]) for x in sets])
            del sets
            links, edges = np.zeros(m, np.int64), []
            for i, j, shared in overlaps(grams, owner, size[own], threshold, class_=class_, left=left):
                jaccard = shared / (size[own[i]] + size[own[j]] - shared)
                linked_ = jaccard >= threshold - 1e-12
                i, j, jaccard = i[linked_], j[linked_], jaccard[linked_]
                if as_pairs:
                    x, y = doc[own[i]], doc[own[j]]
                    out.append(pa.table([np.minimum(x, y), np.maximum(x, y), jaccard], schema=schema))
                    continue
                links += np.bincount(i, weights=copies[own[j]], minlength=m).astype(np.int64) + np.bincount(j, weights=copies[own[i]], minlength=m).astype(np.int64)
                label = connected(i, j, m)  # of these edges, the components are all that is needed
                edges.append((np.flatnonzero(label != np.arange(m)), label[label != np.arange(m)]))
            has = np.flatnonzero(links)
            if not as_pairs and len(has):
                label = connected(*(np.concatenate([e[k] for e in edges]) for k in range(2)), m)
                out.append(pa.table([node[own[has]], doc[own[has]], doc[own[label[has]]], links[has]], schema=schema))
        return pa.concat_tables(out)

    return run


def _compared(docs: DataFrame, n: int, threshold: float, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All texts that may have a partner, classes of equal sets, and what was found between classes."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1], n at least 1")
    source = texts_of(docs)
    slots = exchange_parts(source)
    cut = source.mapInArrow(_cut(n, slots), _PACKED)
    told = cut.groupBy("slot").applyInArrow(_count, _PACKED)
    sets = written(told.groupBy("batch").applyInArrow(_survivors(threshold), _SETS))

    # equal sets have equal ranks: a class keeps those of any member
    classes = written(sets.groupBy("set_hash", "size").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("ranks").alias("ranks")))
    prefixes = classes.select("node", "size", "ranks")
    rare = prefixes.mapInArrow(_rare(threshold, slots), "slot int, blob binary")
    met = rare.groupBy("slot").applyInArrow(_met(threshold), "a long, b long, shared int, least int")
    ties = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")
    hot = prefixes.mapInArrow(_hot(threshold), "gram long, node long")
    stars = hot.join(hot.groupBy("gram").agg(F.min("node").alias("least"), F.count("*").alias("holders")).where("holders > 1"), "gram")
    roots = components(ties.unionAll(stars.select(F.col("least").alias("a"), F.col("node").alias("b"))))
    roots = written(roots.select("node", "root"))
    tied = written(classes.join(small(roots), "node").select("root", "node", "doc_id", "copies", classes["size"].alias("size"), "ranks"))
    # large components are cut into blocks
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum(F.octet_length("ranks")) / TILE_BYTES)).cast("int")
    sizes = tied.groupBy("root").agg(blocks.alias("blocks"), F.sum(F.octet_length("ranks")).alias("bytes"))
    cost = sizes.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    large = small(sizes.where("blocks > 1").select(F.col("root").alias("large"), "blocks"))
    placed = tied.join(large, F.col("root") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "size", "node", "doc_id", "copies", "ranks")
    bins = max(2 * parts(docs.sparkSession), cost // TILE_BYTES)
    binned = tiles.withColumn("bin", F.pmod(F.xxhash64("root", "low", "high"), F.lit(bins)))
    # by number, as parts of little data may hold much work and must not be joined to larger ones
    found = binned.repartition(bins, "bin").groupBy("bin").applyInArrow(_tiles(threshold, as_pairs), "doc_a long, doc_b long, jaccard double" if as_pairs else "node long, doc_id long, near long, links long")
    return sets, classes, found


def _members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(doc_id, least, node, copies)`` of texts of classes with several."""
    several = small(classes.where("copies > 1").select("set_hash", "size", F.col("doc_id").alias("least"), F.col("node").alias("class_node"), "copies"))
    return sets.select("doc_id", "set_hash", sets["size"].alias("size")).join(several, ["set_hash", "size"]).select("doc_id", "least", F.col("class_node").alias("node"), "copies")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_a, doc_b, jaccard)``: texts whose sets of ``n``-grams have a Jaccard index of at least ``threshold``, one row for each pair of classes.

    A class of texts with equal sets is given by its least ``doc_id`` with each other ``doc_id`` (index 1), and only that least one is
    paired with other classes: all other pairs follow from these. Where groups of different texts are large, ask for ``linked`` instead. ``doc_a = doc_b`` where different texts share an id.
    """
    sets, classes, found = _compared(docs, n, threshold, True)
    equal = _members(sets, classes).where("doc_id <> least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b")).distinct().withColumn("jaccard", F.lit(1.0))
    return found.unionAll(equal)


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of each ``doc_id`` that isn't null, once.

    Two texts are linked if their Jaccard index is at least ``threshold``. ``n_links`` is the number of texts that a document is linked to, copies
    and all (of a ``doc_id`` with several texts, the sum of theirs). ``class_id`` is the least ``doc_id`` of the group that links, and partners' links, connect; its own for a document without any.
    """
    sets, classes, found = _compared(docs, n, threshold, False)
    found = written(found)
    members = written(_members(sets, classes))
    edges = found.select(F.col("doc_id").alias("a"), F.col("near").alias("b")).unionAll(members.select("doc_id", "least"))
    roots = components(edges)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a text of a class has the links of the class, and those to the other copies
    copies = members.join(small(links.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select("doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    single = found.join(small(classes.where("copies > 1").select("node")), "node", "left_anti").select("doc_id", "links")
    nothing = F.lit(None).cast("long")
    rows = texts_of(docs).where("doc_id is not null").select("doc_id", nothing.alias("root"), nothing.alias("links"))
    rows = rows.unionAll(copies.select("doc_id", nothing, "links")).unionAll(single.select("doc_id", nothing, "links")).unionAll(roots.select(F.col("node"), "root", nothing))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("root"), F.col("doc_id")).alias("class_id"), F.coalesce(F.sum("links"), F.lit(0).cast("long")).alias("n_links"))


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, that of the least ``doc_id``, of each group of near duplicates; rows without a partner stay, whatever they hold. Rows that share a ``doc_id`` stay or go together."""
    sets, classes, found = _compared(docs, n, threshold, False)
    edges = found.select(F.col("doc_id").alias("a"), F.col("near").alias("b")).unionAll(_members(sets, classes).select("doc_id", "least"))
    return without(docs, written(components(edges).where("node <> root").select(F.col("node").alias("doc_id"))))


def brute_pairs(rows: list[tuple], n: int = N, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """The places of all linked pairs of ``(doc_id, text)``, each compared with each, for tests."""
    import re

    sets = {}
    for k, (doc, text) in enumerate(rows):
        if doc is None or text is None:
            continue
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if words:
            sets[k] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    places = sorted(sets)
    return [(a, b) for k, a in enumerate(places) for b in places[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12 and math.isfinite(threshold)]
