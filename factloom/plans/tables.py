"""Tables in the shared folder that cut lineage, and consecutive numbers without a global sort in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark is local, a folder of our own that goes at exit."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: what follows starts from there, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a join side that may be broadcast; a longer one is joined otherwise.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Rows of a task in a shuffle, where there are more tasks than ``spark.sql.shuffle.partitions`` for that.
TASK_ROWS = 250_000


def tasks_for(rows: int, spark: SparkSession) -> int | None:
    """Partitions for a shuffle of so many rows; None where Spark's own number will do."""
    n = -(-rows // TASK_ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """``df`` by hash of ``keys`` in so many partitions that each gets about ``TASK_ROWS`` of ``rows`` at most: what a task holds doesn't grow with the table."""
    n = tasks_for(rows, df.sparkSession)
    return df.repartition(n, *keys) if n else df


def numbered(df: DataFrame, name: str, *order: Column | str, after: int = 0) -> DataFrame:
    """``df`` with numbers ``after + 1, after + 2, ...`` in ``order``.

    Rows are range-partitioned and numbered inside their ranges; only the ranges' sizes, one row each, are summed up in one place.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, (inside + F.col("__before") + F.lit(after)).cast("long")).drop("__range", "__before")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of all the named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
