"""The graph on disk: versions of three Parquet tables, of which a pointer file names the current one."""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.merge import Graph
from factloom.schemas import ENTITIES, FACTS, PROVENANCE

VECTORS = "entity_id long, model string, dim int, vec array<float>, src_hash string"
_TABLES = {"entities": ENTITIES, "facts": FACTS, "provenance": PROVENANCE}


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], schema) for schema in _TABLES.values()))


class Store:
    """A folder of versions on a file system that the driver can write to. A version is complete before the pointer turns to it, so readers never see half of one, and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._open = spark, root, False

    def version(self) -> str | None:
        try:
            with open(f"{self.root}/current.json") as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return None

    def load(self) -> Graph | None:
        version = self.version()
        if version is None:
            return None
        return Graph(*(self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{name}") for name, schema in _TABLES.items()))

    def save(self, graph: Graph) -> str:
        """Facts are partitioned by predicate, which all questions name first."""
        os.makedirs(self.root, exist_ok=True)
        version = uuid.uuid4().hex
        for name, schema in _TABLES.items():
            writer = getattr(graph, name).select(*schema.names).write
            (writer.partitionBy("predicate") if name == "facts" else writer).parquet(f"{self.root}/{version}/{name}")
        with open(f"{self.root}/{version}.json", "w") as f:
            json.dump({"version": version}, f)
        os.replace(f"{self.root}/{version}.json", f"{self.root}/current.json")
        return version

    def vectors(self) -> DataFrame:
        """The index of vectors that is kept beside the graph; empty at first."""
        try:
            with open(f"{self.root}/vectors.json") as f:
                return self.spark.read.schema(VECTORS).parquet(f"{self.root}/{json.load(f)['version']}/vectors")
        except FileNotFoundError:
            return self.spark.createDataFrame([], VECTORS)

    def save_vectors(self, index: DataFrame) -> None:
        os.makedirs(self.root, exist_ok=True)
        version = uuid.uuid4().hex
        index.select(*(c.split()[0] for c in VECTORS.split(", "))).write.parquet(f"{self.root}/{version}/vectors")
        with open(f"{self.root}/{version}.json", "w") as f:
            json.dump({"version": version}, f)
        os.replace(f"{self.root}/{version}.json", f"{self.root}/vectors.json")

    @contextmanager
    def batch(self):
        """The graph to change; assign to ``.graph`` of what it gives. Saved once at the end, not at all after an error. Not to be nested."""
        if self._open:
            raise RuntimeError("a batch is open already")
        self._open = True
        try:
            held = _Held(self.load() or empty(self.spark))
            yield held
            self.save(held.graph)
        finally:
            self._open = False


class _Held:
    def __init__(self, graph: Graph):
        self.graph = graph
