"""Questions to the graph: filtered facts, time travel, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import effective
from factloom.operators.merge import Graph
from factloom.plans.tables import BROADCAST_ROWS, spread

FLOOR, LIMIT, DOSSIER = 0.5, 50, 200
_COLUMNS = ("fact_id", "subject_id", "subject_kind", "subject_name", "subject_repo", "predicate", "object_id", "object_kind", "object_name", "object_lit", "confidence", "extractor", "valid_from", "valid_to")


def holds(as_of: Column | None) -> Column:
    """Whether a version holds: now, or at a moment, from ``valid_from`` up to but not at ``valid_to``."""
    if as_of is None:
        return F.col("valid_to").isNull()
    return (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))


def named(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the names, kinds and repos of their ends. A fact without a subject entity is left out; an object may be a literal.

    Facts without an object are joined by a key of their own, so that they don't gather in one task.
    """
    n = max(facts.count(), entities.count())
    s = entities.select(F.col("entity_id").alias("subject_id"), F.col("kind").alias("subject_kind"), F.col("name").alias("subject_name"), F.col("repo").alias("subject_repo"))
    o = entities.select(F.col("entity_id").alias("object_id"), F.col("kind").alias("object_kind"), F.col("name").alias("object_name"))
    known = spread(facts, n, "subject_id").join(spread(s, n, "subject_id"), "subject_id")
    keyed = known.withColumn("object_key", F.coalesce("object_id", F.xxhash64("fact_id", "subject_id")))
    found = spread(keyed, n, "object_key").join(spread(o.withColumnRenamed("object_id", "o_id"), n, "o_id"), F.expr("object_key = o_id and object_id is not null"), "left")
    return found.drop("object_key", "o_id")


def query_facts(graph: Graph, *, subject: str | None = None, predicate: str | None = None, obj: str | None = None, kind: str | None = None, repo: str | None = None, subject_id: int | None = None, object_id: int | None = None, min_confidence: float = FLOOR, as_of: Column | None = None, decay_at: Column | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Facts that meet all the given conditions, best first, with their sources.

    ``obj`` is an object's name or a literal, ``kind`` that of either end, ``repo`` the subject's. ``decay_at``: confidence as of then. Ties of confidence and
    time go by ``fact_id``. Sources are joined after the limit, for the rows that are left only.
    """
    facts = graph.facts.where(holds(as_of))
    if decay_at is not None:
        facts = facts.withColumn("confidence", effective(F.col("confidence"), F.col("created_at"), decay_at, F.col("extractor")))
    facts = facts.where(F.col("confidence") >= min_confidence)
    for name, value in (("predicate", predicate), ("subject_id", subject_id), ("object_id", object_id)):
        if value is not None:
            facts = facts.where(F.col(name) == value)
    rows = named(facts, graph.entities)
    if subject is not None:
        rows = rows.where(F.col("subject_name") == subject)
    if obj is not None:
        rows = rows.where((F.col("object_name") == obj) | (F.col("object_lit") == obj))
    if kind is not None:
        rows = rows.where((F.col("subject_kind") == kind) | (F.col("object_kind") == kind))
    if repo is not None:
        rows = rows.where(F.col("subject_repo") == repo)
    rows = rows.select(*_COLUMNS)
    if limit is not None:
        rows = rows.orderBy(F.col("confidence").desc(), F.col("valid_from").desc(), "fact_id").limit(limit)
    return with_sources(rows, graph.provenance, limit is not None and limit <= BROADCAST_ROWS)


def with_sources(rows: DataFrame, provenance: DataFrame, few: bool = False) -> DataFrame:
    """``rows`` with their sources; ``few`` of them are sent to where the provenance is."""
    ids = rows.select("fact_id").distinct()
    told = provenance.join(F.broadcast(ids), "fact_id", "left_semi") if few else spread(provenance, provenance.count(), "fact_id").join(ids, "fact_id", "left_semi")
    refs = told.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("prov_id", "source_ref"))), lambda x: x.source_ref).alias("sources"))
    return rows.join(refs, "fact_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def resolve_entity(entities: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    """The entity of that name: the oldest one of the wanted repo, else the oldest of any. One row or none."""
    wanted = F.coalesce(F.col("repo") == F.lit(repo), F.lit(False)) if repo is not None else F.lit(False)
    return entities.where(F.col("name") == name).orderBy(wanted.desc(), "entity_id").limit(1)


def explain_entity(graph: Graph, name: str, repo: str | None = None, limit: int = DOSSIER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entity, what it does, and what is done to it. All three are empty for an unknown name."""
    entity = resolve_entity(graph.entities, name, repo)
    found = entity.select("entity_id").first()
    number = found.entity_id if found else -1
    return entity, query_facts(graph, subject_id=number, min_confidence=0.0, limit=limit), query_facts(graph, object_id=number, min_confidence=0.0, limit=limit)


def predicate_census(facts: DataFrame) -> DataFrame:
    return facts.where("valid_to is null").groupBy("predicate").agg(F.count("*").alias("facts"))
