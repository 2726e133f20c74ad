"""The graph's dashboard: one row of counts, and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import effective, tier
from factloom.schemas import WATCHED

DORMANT = 0.5


def graph_health(facts: DataFrame, entities: DataFrame, now: Column, watched: tuple[str, ...] = WATCHED, floor: float = DORMANT) -> DataFrame:
    """One row: live, superseded, det, der, inferred, oldest, newest, contradictions, duplicates, orphans, dormant, and warnings."""
    live = F.col("valid_to").isNull()
    kind = tier(F.coalesce("extractor", F.lit("")))
    now_worth = effective(F.col("confidence"), F.col("created_at"), now, F.col("extractor"))
    counts = facts.agg(
        F.count_if(live).alias("live"),
        F.count_if(~live).alias("superseded"),
        *(F.count_if(live & (kind == t)).alias(t) for t in ("det", "der", "inferred")),
        F.min(F.when(live, F.col("created_at"))).alias("oldest"),
        F.max(F.when(live, F.col("created_at"))).alias("newest"),
        F.count_if(live & (kind == "inferred") & (now_worth < floor)).alias("dormant"),
    )
    current = facts.where(live)
    value = F.struct(F.coalesce("object_id", F.lit(-1)), F.coalesce("object_lit", F.lit("")))
    torn = current.where(F.col("predicate").isin(*watched)).groupBy("subject_id", "predicate").agg(F.countDistinct(value).alias("n")).agg(F.count_if(F.col("n") > 1).alias("contradictions"))
    twice = current.groupBy("subject_id", "predicate", "object_id", "object_lit").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    subject = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("__name"))
    lost = current.join(subject, "subject_id", "left").agg(F.count_if(F.col("__name").isNull() | (F.trim("__name") == "")).alias("orphans"))
    row = counts.crossJoin(torn).crossJoin(twice).crossJoin(lost)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    told = F.array(
        F.when(share("inferred", "live") > 0.4, "many facts are inferred"),
        F.when(share("duplicates", "live") > 0.05, "many facts are there twice"),
        F.when(F.col("orphans") > 0, "facts without a named subject"),
        F.when(F.col("contradictions") > 0, "single values contradict each other"),
        F.when(share("dormant", "inferred") > 0.3, "many inferred facts are dormant"),
    )
    return row.withColumn("warnings", F.filter(told, lambda x: x.isNotNull()))


def freshness(repos: DataFrame, newest: Column, now: Column) -> DataFrame:
    """One row of ``repos (repo, branch, behind, ahead, dirty, head)``: the largest known lag, the repos that lag, the graph's age in days."""
    lagging = F.when(F.col("behind") > 0, F.concat("repo", F.lit(" is "), F.col("behind"), F.lit(" commits behind")))
    return repos.agg(F.max("behind").alias("behind"), F.sort_array(F.collect_list(lagging)).alias("warnings")).withColumn("age_days", F.round(F.timestamp_diff("SECOND", newest, now) / 86400, 2))


def update_plan(repos: DataFrame) -> DataFrame:
    """``repos`` with ``action``: unknown lag and no lag are skipped, work that isn't committed is never touched, the rest is pulled."""
    action = F.when(F.col("behind").isNull(), "skip-unknown").when(F.col("behind") == 0, "skip-fresh").when(F.coalesce("dirty", F.lit(-1)) != 0, "skip-dirty").otherwise("pull")
    return repos.withColumn("action", action)
