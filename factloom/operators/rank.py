"""Lexical ranking with a floor, so that nothing is guessed, and cosine ranking of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import NOISE, base_name, folded, terms
from factloom.operators.merge import Graph
from factloom.plans.tables import small

#: Rows of a block in a product, and numbers (rows times dimension) of each side of a tile.
BLOCK, TILE = 1024, 4_000_000
FOUND = pa.schema([("query_id", pa.int64()), ("entity_id", pa.int64()), ("score", pa.float64())])
TOP, NAME_FLOOR, LESSON_FLOOR, LESSONS = 5, 3, 2, 2


def defined_symbols(graph: Graph, repo: str | None = None) -> DataFrame:
    """``(name, path, line)``: symbols with a path, and the least line among the places where they are defined."""
    symbols = graph.entities.where("kind = 'symbol' and path is not null")
    if repo is not None:
        symbols = symbols.where(F.col("repo") == repo)
    lines = graph.facts.where("predicate = 'defined-in'").join(graph.provenance, "fact_id").select(F.col("subject_id").alias("entity_id"), F.expr("try_cast(nullif(regexp_extract(source_ref, ':([0-9]+)$', 1), '') as int)").alias("line"))
    return symbols.join(lines, "entity_id", "left").groupBy("name", "path").agg(F.min("line").alias("line"))


def scored(asked: DataFrame, items: DataFrame) -> DataFrame:
    """``(task_id, item_id, score)`` over 0: two points for each of a task's distinct ``terms`` inside an item's ``strong`` text, one for each inside its ``weak`` text.

    ``asked (task_id, terms)``, ``items (item_id, strong, weak)``. A term is inside a text only where the text has the term's first three letters: distinct terms and distinct
    texts are joined by these, so no task is laid beside an item that shares nothing with it. Terms have three letters or more.
    """
    wanted = asked.select("task_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = wanted.select("term", F.substring("term", 1, 3).alias("head")).distinct()
    both = items.select("item_id", F.col("strong").alias("text"), F.lit(2).alias("points")).unionAll(items.select("item_id", "weak", F.lit(1))).distinct().where(F.length("text") >= 3)
    texts = both.select("text").distinct()
    heads = texts.select("text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda k: F.substr("text", k, F.lit(3))))).alias("head"))
    inside = heads.join(small(words), "head").where(F.col("text").contains(F.col("term"))).select("text", "term")
    points = both.join(inside, "text").groupBy("item_id", "term").agg(F.sum("points").alias("points"))
    return points.join(small(wanted), "term").groupBy("task_id", "item_id").agg(F.sum("points").cast("int").alias("score"))


def ranked_symbols(tasks: DataFrame, symbols: DataFrame, top: int = TOP, floor: int = NAME_FLOOR) -> DataFrame:
    """``(task_id, name, path, line, score, place)``: the best symbols of each of ``tasks (task_id, text)``. Two points for a term in the name, one for a term
    in the file's name; tests, documents and the like don't count. Ties go by name and path."""
    clean = symbols.where(~F.lower("path").rlike(NOISE)).select(F.struct("name", "path", "line").alias("item_id"), F.lower("name").alias("strong"), F.lower(base_name(F.col("path"))).alias("weak"))
    asked = tasks.select("task_id", terms(F.col("text")).alias("terms"))
    found = scored(asked, clean).where(F.col("score") >= floor).select("task_id", "item_id.*", "score")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("score").desc(), "name", "path"))
    return found.withColumn("place", place).where(F.col("place") <= top).select("task_id", "name", "path", "line", "score", "place")


def relevant_lessons(tasks: DataFrame, lessons: DataFrame, top: int = LESSONS, floor: int = LESSON_FLOOR) -> DataFrame:
    """``(task_id, text, score)``: the best distinct texts of ``lessons (topic, text)``; spellings are folded on both sides."""
    asked = tasks.select("task_id", terms(F.col("text")).alias("terms"))
    plain = lambda c: folded(F.lower(F.coalesce(c, F.lit(""))))
    items = lessons.select(F.struct("topic", "text").alias("item_id"), plain("topic").alias("strong"), plain("text").alias("weak")).distinct()
    found = scored(asked, items).where(F.col("score") >= floor)
    best = found.withColumn("shown", F.coalesce("item_id.text", "item_id.topic")).groupBy("task_id", "shown").agg(F.max("score").alias("score"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("score").desc(), "shown"))).where(F.col("n") <= top).select("task_id", F.col("shown").alias("text"), "score")


def _groups(queries: DataFrame, vectors: DataFrame) -> tuple[int, int]:
    """Into how many groups each side is cut, so that a group has about ``TILE`` numbers at most, and all cores have tiles where there is more than a block's work."""
    sizes = [df.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first() for df in (queries, vectors)]
    (_, a), (_, b) = sizes
    n, m = max(1, -(-a // TILE)), max(1, -(-b // TILE))
    if max(rows for rows, _ in sizes) > BLOCK:
        while n * m < 4 * queries.sparkSession.sparkContext.defaultParallelism:
            n, m = (n + 1, m) if a * m > b * n else (n, m + 1)
    return n, m


def _arrays(side: pa.Table) -> dict[int, tuple[pa.ChunkedArray, np.ndarray]]:
    """Ids and a matrix of vectors, rows in order of ids, for each dimension."""
    side = side.combine_chunks().sort_by("id")
    sizes = pc.list_value_length(side["vec"]).to_numpy()
    found = {}
    for size in np.unique(sizes):
        rows = side.filter(pa.array(sizes == size))
        vecs = pc.list_flatten(rows["vec"]).to_numpy().reshape(rows.num_rows, int(size))
        found[int(size)] = rows["id"], vecs.astype(np.float64)
    return found


def _best_places(queries: np.ndarray, vecs: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``vecs`` of the best of each of ``queries``, and their rounded scores; a row each. Ties go by place.

    What is below the ``top``-th score by more than rounding can mend is left out; the rest is rounded and sorted.
    """
    best = score = None
    for start in range(0, len(vecs), BLOCK):
        new = queries @ vecs[start : start + BLOCK].T
        key = np.where(np.isnan(new), np.inf, new) if np.isnan(new).any() else new
        if best is not None and best.shape[1] == top:
            least = np.where(np.isnan(score[:, -1]), np.inf, score[:, -1])
        else:
            least = np.partition(key, -top, axis=1)[:, -top] if key.shape[1] > top else np.full(len(key), -np.inf)
        row, at = np.nonzero(key >= least[:, None] - 2e-4)
        if best is not None and not len(row):
            continue
        place, value = at + start, np.round(new[row, at], 4)
        if best is not None:
            row = np.concatenate([np.repeat(np.arange(len(best)), best.shape[1]), row])
            place, value = np.concatenate([best.ravel(), place]), np.concatenate([score.ravel(), value])
        order = np.lexsort((place, np.where(np.isnan(value), -np.inf, -value), row))
        row, place, value = row[order], place[order], value[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < top
        best, score = place[kept].reshape(len(queries), -1), value[kept].reshape(len(queries), -1)
    return best, score


def _best(top: int):
    def run(tile: pa.Table) -> pa.Table:
        asked, held = (_arrays(tile.filter(pc.equal(tile["asked"], side)).select(["id", "vec"])) for side in (True, False))
        out = []
        for size in asked.keys() & held.keys():
            (query_ids, queries), (ids, vecs) = asked[size], held[size]
            for start in range(0, len(queries), BLOCK):
                place, score = _best_places(queries[start : start + BLOCK], vecs, top)
                row = np.repeat(np.arange(start, start + len(place)), place.shape[1])
                out.append(pa.table({"query_id": query_ids.take(row), "entity_id": ids.take(place.ravel()), "score": score.ravel()}).cast(FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return run


def cosine_top(queries: DataFrame, vectors: DataFrame, top: int = TOP) -> DataFrame:
    """``(query_id, entity_id, score, place)`` for ``queries (query_id, vec)`` against ``vectors (entity_id, vec)``, all of length 1; other dimensions don't match.

    Both sides are cut into groups by hash. Each group of one side meets each of the other in a tile, a task's worth of bounded size, which is worked through in
    products of blocks; the best of each query in a tile go on. A row goes to as many tiles as the other side has groups. Null vectors are near nothing.
    """
    asked, held = queries.where("vec is not null"), vectors.where("vec is not null")
    n, m = _groups(asked, held)
    group = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count))
    each = lambda count, tile: F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), tile)).alias("tile")
    vec = F.col("vec").cast("array<double>" if dict(asked.dtypes)["vec"] == "array<double>" or dict(held.dtypes)["vec"] == "array<double>" else "array<float>").alias("vec")
    left = asked.select(each(m, lambda k: group("query_id", n) * m + k), F.lit(True).alias("asked"), F.col("query_id").alias("id"), vec)
    right = held.select(each(n, lambda k: k * m + group("entity_id", m)), F.lit(False).alias("asked"), F.col("entity_id").alias("id"), vec)
    tiles = left.unionByName(right).repartition(n * m, "tile")
    local = tiles.groupBy("tile").applyInArrow(_best(top), "query_id long, entity_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entity_id"))
    return local.withColumn("place", place).where(F.col("place") <= top).select("query_id", "entity_id", "score", "place")


def hybrid(lexical: DataFrame, semantic: DataFrame, top: int = TOP) -> DataFrame:
    """``(task_id, name, path, source, place)`` of two rankings ``(task_id, name, path, place)``: lexical ones first, then semantic ones that aren't among them."""
    both = lexical.select("task_id", "name", "path", "place", F.lit("lexical").alias("source")).unionByName(semantic.where("path is not null").select("task_id", "name", "path", "place", F.lit("semantic").alias("source")))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("task_id", "name", "path").orderBy("source", "place"))).where("n = 1")
    order = Window.partitionBy("task_id").orderBy("source", "place", "name", "path")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("task_id", "name", "path", "source", F.col("rank").alias("place"))
