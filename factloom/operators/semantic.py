"""Vectors of entities: embed what changed, propose what is near."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vectors import normalised
from factloom.operators.merge import Graph
from factloom.operators.rank import cosine_top, defined_symbols

BATCH, BEFORE, AFTER = 64, 3, 27
Embedder = Callable[[list[str]], list[list[float]]]


def http_embedder(endpoint: str, model: str, api_key: str = "none", timeout: float = 120) -> Embedder:
    """An embedder behind an HTTP service: posts ``{model, input}`` to ``endpoint/embeddings`` and takes ``data[].embedding`` in order of ``index``. Any failure is raised."""

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": list(texts)}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{endpoint.rstrip('/')}/embeddings", body, headers), timeout=timeout) as answer:
            rows = json.load(answer)["data"]
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [row["embedding"] for _, row in sorted(enumerate(rows), key=lambda x: x[1].get("index", x[0]))]

    return embed


def texts_to_index(graph: Graph, files: DataFrame, repo: str | None = None) -> DataFrame:
    """``(entity_id, text, seq)``: a window of source for each defined symbol, and for each topic its newest lesson."""
    symbols = window_text(files, defined_symbols(graph, repo))
    where = graph.entities.where("kind = 'symbol' and path is not null")
    where = where if repo is None else where.where(F.col("repo") == repo)
    ids = where.groupBy("name", "path").agg(F.min("entity_id").alias("entity_id"))
    of_symbols = symbols.join(ids, ["name", "path"]).select("entity_id", "text", F.lit(0).cast("long").alias("seq"))
    told = graph.current().where("predicate = 'lesson' and object_lit is not null")
    topics = graph.entities.select(F.col("entity_id").alias("subject_id"), "name")
    lessons = told.join(topics, "subject_id").select(F.col("subject_id").alias("entity_id"), F.concat_ws("\n", "name", "object_lit").alias("text"), F.col("fact_id").alias("seq"))
    return of_symbols.unionAll(lessons)


def window_text(files: DataFrame, symbols: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``(name, path, text)``: each symbol's lines around its definition, under a line of name and path. Symbols without a line have the head only."""
    joined = symbols.join(files.select("path", "source"), "path", "left")
    lines = F.split("source", r"\r?\n")
    start = F.greatest(F.lit(1), F.col("line") - before)
    shown = F.slice(lines, start, F.greatest(F.lit(0), F.least(F.size(lines), F.col("line") + after) - start + 1))
    return joined.select("name", "path", F.concat(F.col("name"), F.lit(" — "), F.col("path"), F.when(F.col("line").isNotNull() & F.col("source").isNotNull(), F.concat(F.lit("\n"), F.array_join(shown, "\n"))).otherwise("")).alias("text"))


def to_embed(texts: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """``(entity_id, text, src_hash)`` of ``texts (entity_id, text)`` whose hash isn't in the index for this model."""
    hashed = texts.withColumn("src_hash", F.sha2("text", 256))
    known = index.where(F.col("model") == model)
    return hashed.join(known.select("entity_id", "src_hash"), ["entity_id", "src_hash"], "left_anti").select("entity_id", "text", "src_hash")


def embedded(texts: DataFrame, embed: Embedder, model: str, batch: int = BATCH) -> DataFrame:
    """``(entity_id, model, dim, vec, src_hash)``. The embedder runs where the rows are, on batches of texts; its failure is the job's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = [np.asarray(v, dtype=np.float32) for v in embed(part.text.tolist())]
                yield pd.DataFrame({"entity_id": part.entity_id, "model": model, "dim": [len(v) for v in vectors], "vec": vectors, "src_hash": part.src_hash})

    return texts.mapInPandas(run, "entity_id long, model string, dim int, vec array<float>, src_hash string").withColumn("vec", normalised(F.col("vec")))


def reindexed(index: DataFrame, texts: DataFrame, embed: Embedder, model: str) -> DataFrame:
    """The index after what changed was embedded. Of an entity's several texts the one of the largest ``seq`` counts."""
    latest = texts.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("seq").desc()))).where("n = 1") if "seq" in texts.columns else texts
    new = embedded(to_embed(latest, index, model), embed, model)
    kept = index.join(new.select("entity_id"), "entity_id", "left_anti")
    return kept.unionByName(new.select(*index.columns))


def proposed(tasks: DataFrame, index: DataFrame, graph: Graph, embed: Embedder, model: str, top: int = 5, repo: str | None = None) -> DataFrame:
    """``(task_id, name, path, line, score, place)``: symbols with a path whose vectors of the same model are nearest to the tasks'."""
    queries = embedded(tasks.select(F.col("task_id").alias("entity_id"), "text", F.lit("").alias("src_hash")), embed, model).select(F.col("entity_id").alias("query_id"), "vec")
    entities = graph.entities.where("path is not null") if repo is None else graph.entities.where(F.col("path").isNotNull() & (F.col("repo") == repo))
    vectors = index.where(F.col("model") == model).join(entities.select("entity_id"), "entity_id", "left_semi").select("entity_id", "vec")
    best = cosine_top(queries, vectors, top).join(entities.select("entity_id", "name", "path"), "entity_id")
    return best.join(defined_symbols(graph, repo), ["name", "path"], "left").select(F.col("query_id").alias("task_id"), "name", "path", "line", "score", "place")
