"""Refreshing a stored graph from a stream of candidates, one merge per micro-batch."""

from __future__ import annotations

import fcntl
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.merge import consolidated
from factloom.operators.store import Store
from factloom.schemas import CANDIDATES


@contextmanager
def only_one(path: str):
    """True for the one holder of the lock file, False for others, at once."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            yield False
            return
        yield True


def refresh(store: Store, candidates: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts a query that merges each micro-batch of ``candidates`` into the store. Without ``interval`` it takes what is there and ends.

    A batch that is replayed after a failure finds its triples and evidence in the graph: nothing is added twice, though inferred facts are corroborated again; the number of
    the last merged batch is kept beside the store, and such a replay is skipped.
    """
    marker = f"{store.root}/batch"

    def merge(batch: DataFrame, number: int) -> None:
        try:
            with open(marker) as f:
                if int(f.read()) >= number:
                    return
        except FileNotFoundError:
            pass
        if not batch.isEmpty():
            with store.batch() as held:
                held.graph = consolidated(held.graph, batch.select(*CANDIDATES.names), F.current_timestamp())
        os.makedirs(store.root, exist_ok=True)
        with open(f"{marker}.new", "w") as f:
            f.write(str(number))
        os.replace(f"{marker}.new", marker)

    writer = candidates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
