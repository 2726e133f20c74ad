"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``, ``root`` being the least node of the component, for each node of ``edges (a, b)`` of longs.

    Large-star and small-star steps alternate until nothing changes, which takes about log² of the longest path in steps, each of
    them one shuffle of the edges. Edges with a null end and loops are left out; a node that has no other edge isn't listed.
    Repeated edges count once; an empty table gives an empty table.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = written(pairs), None
    while True:
        # large star: larger neighbours of a node are tied to the least node beside it
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: smaller neighbours and the node itself are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = written(small)
        after = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
