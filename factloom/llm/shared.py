"""Tables written to the folder that all executors share, and broadcasts whose size is checked."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a join side that may be broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of input for each part of an exchange of packed numbers, at most.
PART_BYTES = 32 << 20


#: Bytes of rows that go to a Python worker at once. Rows are as long as they are; this bounds what is held beside them.
ARROW_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Sets the session's bound on Arrow batches, unless it is tighter already: workers of several tasks share an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name, None) or "") or 1 << 62) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)
    return spark


def texts_of(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)`` of ``docs``, whatever other columns there are."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, one after the other."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where that is unset and Spark is local, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(kind: T.DataType, column: Column) -> Column:
    """Bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return F.greatest(F.size(column), F.lit(0)) * each + 16
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``BROADCAST_BYTES``, else as it is, to be joined by shuffle."""
    width = sum((_width(f.dataType, df[f"`{f.name}`"]) for f in df.schema.fields), F.lit(16)).cast("long")
    n = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` isn't in the written table ``dropped``; a null ``doc_id`` stays. Columns of ``docs`` stay as they are, whatever their names."""
    ids = small(dropped.select(F.col("doc_id").alias(free_name(docs, "dropped"))))
    return docs.join(ids, docs["doc_id"] == ids[ids.columns[0]], "left_anti")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange_parts(df: DataFrame) -> int:
    """Parts of an exchange over all of ``df``: twice the session's shuffle partitions, and more if the files it reads are so large that a part would exceed ``PART_BYTES``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    # a plan of unknown size says so by a number near the largest long
    return max(2 * parts(df.sparkSession), -(-size // PART_BYTES) if size < 1 << 60 else 1)

