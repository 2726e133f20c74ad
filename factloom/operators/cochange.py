"""Items that change together: pairs inside groups, bounded by the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import from_support
from factloom.operators.derive import capped
from factloom.plans.tables import spread

LEAST, MOST, SUPPORT, CAP = 2, 12, 3, 50_000
CODE = ("py", "swift", "kt", "ts", "tsx", "js", "go", "rs")


def pairs(groups: DataFrame, min_support: int = SUPPORT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``(a, b, support)``, ``a < b``, of ``groups (grp, item)``. Groups of fewer than ``least`` or more than ``most`` distinct items are left out whole.

    The bound keeps a group's pairs few: they are made inside the group's own array, so the only shuffles are by group and by pair,
    both in tasks of a bounded number of rows.
    """
    known = groups.where("grp is not null and item is not null")
    rows = known.count()
    sets = spread(known, rows, "grp").groupBy("grp").agg(F.sort_array(F.collect_set("item")).alias("items"))
    bounded = sets.where(F.size("items").between(least, most))
    first = bounded.select(F.posexplode("items").alias("k", "a"), "items")
    both = first.select("a", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("b"))
    return spread(both, rows, "a", "b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def facts(pairs_: DataFrame, cap: int = CAP) -> DataFrame:
    """``(subject, object, confidence, support)`` in both directions, of the best supported pairs, which stay whole under the cap."""
    best = capped(pairs_, cap // 2, "co-changes", F.col("support").desc(), "a", "b")
    ways = F.explode(F.array(F.struct(F.col("a").alias("subject"), F.col("b").alias("object")), F.struct(F.col("b").alias("subject"), F.col("a").alias("object"))))
    return best.select(ways.alias("way"), from_support(F.col("support")).alias("confidence"), "support").select("way.subject", "way.object", "confidence", "support")


def code_only(pairs_: DataFrame, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """Pairs of which both ends are code files."""
    is_code = lambda c: F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1)).isin(*extensions)
    return pairs_.where(is_code(F.col("a")) & is_code(F.col("b")))
