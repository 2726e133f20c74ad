"""Entities by null-safe key (kind, name, repo)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.tables import numbered, same


def upserted(entities: DataFrame, mentions: DataFrame, now: Column) -> DataFrame:
    """``entities`` after ``mentions (kind, name, repo, path, seq)``.

    An unknown key becomes an entity with the first path that is mentioned; a known one without a path takes that path,
    which alone changes ``last_seen``. Ids go on from the largest one in order of first mention. A null repo is a repo of its own.
    """
    first = mentions.groupBy("kind", "name", "repo").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("new_path"), F.min("seq").alias("seq"))
    joined = entities.alias("e").join(first.select(*(F.col(c).alias(f"m_{c}") for c in first.columns)).alias("m"), F.expr("e.kind <=> m_kind and e.name <=> m_name and e.repo <=> m_repo"), "left")
    filled = F.col("path").isNull() & F.col("m_new_path").isNotNull()
    kept = joined.select("entity_id", "kind", "name", "repo", F.when(filled, F.col("m_new_path")).otherwise(F.col("path")).alias("path"), "meta", "first_seen", F.when(filled, now).otherwise(F.col("last_seen")).alias("last_seen"))
    fresh = first.join(entities, same(first, entities, "kind", "name", "repo"), "left_anti")
    most = entities.agg(F.max("entity_id")).first()[0] or 0
    added = numbered(fresh, "entity_id", "seq", "kind", "name", "repo", after=most)
    return kept.unionByName(added.select("entity_id", "kind", "name", "repo", F.col("new_path").alias("path"), F.lit(None).cast("string").alias("meta"), now.cast("timestamp").alias("first_seen"), now.cast("timestamp").alias("last_seen")))


def distinct_keys(mentions: DataFrame) -> DataFrame:
    """One row per (kind, name, repo), nulls being equal, with the first path mentioned and the number of mentions."""
    return mentions.groupBy("kind", "name", "repo").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path"), F.count("*").alias("mentions"))
