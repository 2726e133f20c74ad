"""Merging candidates into the graph: corroboration, soft supersession, pruning.

Facts are versions that are closed, never deleted. Candidates for predicates with many values are merged as sets; those for single-valued
predicates depend on their order, and are folded slot by slot (subject, predicate), in parallel over slots.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import CAP, corroborated
from factloom.operators.entities import upserted
from factloom.plans.tables import cut, numbered, same
from factloom.schemas import SINGLE_VALUED

TRIPLE = ("subject_id", "predicate", "object_id", "object_lit")


@dataclass
class Graph:
    entities: DataFrame
    facts: DataFrame
    provenance: DataFrame

    def current(self) -> DataFrame:
        return self.facts.where("valid_to is null")


def source_kind(origin: Column) -> Column:
    return F.when(origin.startswith("doc:"), "doc").when(origin.startswith("git:"), "commit").when(origin.startswith("code:"), "code_line").otherwise("derived")


def fold(start: Column, confidences: Column) -> Column:
    """Confidence after each of the given ones has corroborated it, in turn."""
    return F.aggregate(confidences, start, corroborated)


def merged_values(current: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Candidates for many-valued predicates, set-wise: one row per distinct key with ``confidence`` after the merge, ``extractor``, and how many were ``added`` and ``merged``.

    ``current (key, confidence, extractor)`` holds at most one row per key; ``candidates (key, seq, confidence, extractor)``. A fact of a ``det:`` extractor keeps its confidence.
    """
    ordered = candidates.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "confidence", "extractor"))), lambda x: F.struct(x.confidence.alias("confidence"), x.extractor.alias("extractor"))).alias("offers"))
    renamed = current.select(*(F.col(k).alias(f"c_{k}") for k in key), F.col("confidence").alias("old_confidence"), F.col("extractor").alias("old_extractor"))
    joined = ordered.join(renamed, F.expr(" and ".join(f"{k} <=> c_{k}" for k in key)), "left")
    known = F.col("old_extractor").isNotNull()
    first = F.col("offers")[0]
    extractor = F.when(known, F.col("old_extractor")).otherwise(first["extractor"])
    start = F.when(known, F.col("old_confidence")).otherwise(first["confidence"])
    more = F.transform(F.when(known, F.col("offers")).otherwise(F.slice(F.col("offers"), 2, F.greatest(F.lit(1), F.size("offers")))), lambda x: x.confidence)
    bumped = F.when(extractor.startswith("det:"), start).otherwise(fold(start, more))
    return joined.select(*key, bumped.alias("confidence"), extractor.alias("extractor"), F.when(known, 0).otherwise(1).alias("added"), (F.size("offers") - F.when(known, 0).otherwise(1)).alias("merged"))


_SLOT = pa.schema([("subject_id", pa.int64()), ("predicate", pa.string()), ("object_id", pa.int64()), ("object_lit", pa.string()), ("confidence", pa.float64()), ("extractor", pa.string()), ("current", pa.bool_()), ("fact_id", pa.int64()), ("superseded_by_object_id", pa.int64()), ("superseded_by_object_lit", pa.string()), ("seq", pa.int64()), ("status", pa.string())])
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}


def _better(old: float, new: float) -> float:
    best = max(old, new)
    return round(min(CAP, best + (1.0 - best) * 0.3), 4)


def _slot(subject: int, predicate: str, rows: list[tuple]) -> list[tuple]:
    """One slot's versions after its candidates. Rows are (is a candidate, number, object_id, object_lit, confidence, extractor), facts first."""
    held: list[dict] = []
    for offered, number, object_id, object_lit, worth, extractor in rows:
        value = (object_id, object_lit)
        if not offered:
            held.append(dict(fact_id=number, value=value, worth=worth, extractor=extractor, current=True, by=None, seq=-1, status="kept"))
            continue
        live = [r for r in held if r["current"]]
        if same_ := [r for r in live if r["value"] == value]:
            if not same_[0]["extractor"].startswith("det:"):
                same_[0]["worth"] = _better(same_[0]["worth"], worth)
            continue
        rivals = [r for r in live if not r["extractor"].startswith("det:")]
        if (rivals and worth < rivals[0]["worth"]) or (live and not rivals):
            continue  # weaker than what is held, or held by a deterministic fact
        if rivals:
            rivals[0].update(current=False, by=value)
        if closed := [r for r in held if r["value"] == value and r["status"] == "added"]:
            closed[0].update(current=True, by=None)  # came back within this batch: the version is opened again, as it was given
        else:
            held.append(dict(fact_id=None, value=value, worth=worth, extractor=extractor, current=True, by=None, seq=number, status="added"))
    return [(subject, predicate, *r["value"], r["worth"], r["extractor"], r["current"], r["fact_id"], *(r["by"] or (None, None)), r["seq"], r["status"]) for r in held]


def _slots(table: pa.Table) -> pa.Table:
    """All slots of one bin, one after the other."""
    columns = ("subject_id", "predicate", "offered", "number", "object_id", "object_lit", "confidence", "extractor")
    rows = sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True), key=lambda r: (r[0], r[1], r[2], r[3]))
    out = [x for (subject, predicate), own in groupby(rows, key=lambda r: r[:2]) for x in _slot(subject, predicate, [r[2:] for r in own])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_SLOT), _SLOT, strict=True)], schema=_SLOT)


def resolved_slots(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Single-valued slots after their candidates, in order of ``seq``: all versions that were or became current.

    The same value again corroborates. Another one replaces the first non-deterministic value if it is at least as confident, and is dropped if it is weaker or only
    deterministic values are held. Slots are gathered in bins, so that Python is called once for many of them.
    """
    fields = ["subject_id", "predicate", "object_id", "object_lit", "confidence", "extractor"]
    rows = current.select(F.lit(False).alias("offered"), F.col("fact_id").alias("number"), *fields).unionByName(candidates.select(F.lit(True).alias("offered"), F.col("seq").alias("number"), *fields))
    bins = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy(F.pmod(F.hash("subject_id", "predicate"), F.lit(bins)).alias("bin")).applyInArrow(_slots, ", ".join(f"{f.name} {_KINDS[f.type]}" for f in _SLOT))


def resolved(graph: Graph, candidates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Entities after the candidates' mentions, and the candidates with ids of subjects and objects."""
    candidates = cut(candidates.withColumn("subject_path", F.col("subject_path")))
    of_modules = F.coalesce(F.col("object_kind"), F.lit("module"))
    object_repo = F.when(of_modules != "module", F.col("subject_repo"))
    subjects = candidates.select(F.col("subject_kind").alias("kind"), F.col("subject_name").alias("name"), F.col("subject_repo").alias("repo"), F.col("subject_path").alias("path"), (F.col("seq") * 2).alias("seq"))
    objects = candidates.where("object_lit is null").select(of_modules.alias("kind"), F.coalesce("object_name", F.lit("")).alias("name"), object_repo.alias("repo"), F.when(F.col("object_kind") == "file", F.col("object_name")).alias("path"), (F.col("seq") * 2 + 1).alias("seq"))
    entities = cut(upserted(graph.entities, subjects.unionByName(objects), now))
    ids = entities.select("entity_id", "kind", "name", "repo")
    s, o = ids.alias("s"), ids.alias("o")
    named = candidates.withColumns({"object_kind_": of_modules, "object_name_": F.coalesce("object_name", F.lit("")), "object_repo_": object_repo})
    with_subject = named.join(s, F.expr("subject_kind <=> s.kind and subject_name <=> s.name and subject_repo <=> s.repo")).select(named["*"], F.col("s.entity_id").alias("subject_id"))
    both = with_subject.join(o, F.expr("object_lit is null and object_kind_ <=> o.kind and object_name_ <=> o.name and object_repo_ <=> o.repo"), "left")
    return entities, cut(both.select(with_subject["*"], F.col("o.entity_id").alias("object_id")).drop("object_kind_", "object_name_", "object_repo_"))


def consolidated(graph: Graph, candidates: DataFrame, now: Column, single_valued: tuple[str, ...] = SINGLE_VALUED) -> Graph:
    """The graph after ``candidates`` (schema ``CANDIDATES``). Raises if a candidate has both an object and a literal, or neither."""
    if not candidates.where("(object_name is null) = (object_lit is null)").isEmpty():
        raise ValueError("a candidate has exactly one of object_name and object_lit")
    now = now.cast("timestamp")
    entities, found = resolved(graph, candidates, now)
    current = graph.current()
    alone = F.col("predicate").isin(*single_valued) if single_valued else F.lit(False)
    least = current.groupBy(*TRIPLE).agg(F.min("fact_id").alias("fact_id"), F.min_by("confidence", "fact_id").alias("confidence"), F.min_by("extractor", "fact_id").alias("extractor"))
    many = cut(merged_values(least, found.where(~alone), list(TRIPLE)))
    slots = cut(resolved_slots(current.where(alone), found.where(alone)))

    # versions that were there
    changed = many.where("added = 0").select(*TRIPLE, F.col("confidence").alias("new_confidence"))
    target = least.select(*TRIPLE, "fact_id").alias("l").join(changed.alias("c"), F.expr(" and ".join(f"l.{k} <=> c.{k}" for k in TRIPLE))).select("l.fact_id", "c.new_confidence")
    slot_old = slots.where("fact_id is not null")
    target = target.unionAll(slot_old.where("current").select("fact_id", F.col("confidence")))
    old = graph.facts.join(target.withColumnRenamed("fact_id", "t_id"), F.col("fact_id") == F.col("t_id"), "left").withColumn("confidence", F.coalesce("new_confidence", "confidence")).drop("t_id", "new_confidence")

    # new ones
    firsts = found.groupBy(*TRIPLE).agg(F.min("seq").alias("seq"))
    new_many = many.where("added = 1").alias("m").join(firsts.alias("f"), F.expr(" and ".join(f"m.{k} <=> f.{k}" for k in TRIPLE))).select(*(f"m.{k}" for k in TRIPLE), "m.confidence", "m.extractor", F.lit(True).alias("current"), F.lit(None).cast("long").alias("by_id"), F.lit(None).cast("string").alias("by_lit"), "f.seq")
    new_slots = slots.where("fact_id is null").select(*TRIPLE, "confidence", "extractor", "current", F.col("superseded_by_object_id").alias("by_id"), F.col("superseded_by_object_lit").alias("by_lit"), "seq")
    most = graph.facts.agg(F.max("fact_id")).first()[0] or 0
    fresh = cut(numbered(new_many.unionByName(new_slots), "fact_id", "seq", after=most))
    winners = fresh.select(F.col("fact_id").alias("w_id"), *(F.col(k).alias(f"w_{k}") for k in TRIPLE))
    by_winner = F.expr("subject_id <=> w_subject_id and predicate <=> w_predicate and by_id <=> w_object_id and by_lit <=> w_object_lit and not current")
    new_rows = fresh.join(winners, by_winner, "left").select("fact_id", *TRIPLE, "confidence", "extractor", now.alias("created_at"), now.alias("valid_from"), F.when(~F.col("current"), now).alias("valid_to"), F.col("w_id").alias("superseded_by"))
    closed = slot_old.where("not current").select(F.col("fact_id").alias("closed_id"), "subject_id", "predicate", F.col("superseded_by_object_id").alias("by_id"), F.col("superseded_by_object_lit").alias("by_lit"), "current")
    closed = closed.join(winners, by_winner, "left").select("closed_id", F.col("w_id").alias("winner"))
    old = old.join(closed, F.col("fact_id") == F.col("closed_id"), "left").withColumn("valid_to", F.when(F.col("closed_id").isNotNull(), now).otherwise(F.col("valid_to"))).withColumn("superseded_by", F.coalesce("winner", "superseded_by")).drop("closed_id", "winner")
    facts = cut(old.unionByName(new_rows))

    # evidence of every candidate whose fact is in the graph, once each
    holders = facts.where(F.col("valid_to").isNull() | (F.col("created_at") == now)).groupBy(*TRIPLE).agg(F.min("fact_id").alias("fact_id"))
    told = found.alias("f").join(holders.alias("h"), F.expr(" and ".join(f"f.{k} <=> h.{k}" for k in TRIPLE))).select("h.fact_id", source_kind(F.col("f.origin")).alias("source_kind"), F.col("f.origin").alias("source_ref"), "f.excerpt", "f.seq")
    told = told.groupBy("fact_id", "source_kind", "source_ref").agg(F.min_by("excerpt", "seq").alias("excerpt"), F.min("seq").alias("seq"))
    told = told.join(graph.provenance, same(told, graph.provenance, "fact_id", "source_kind", "source_ref"), "left_anti")
    last = graph.provenance.agg(F.max("prov_id")).first()[0] or 0
    evidence = numbered(told, "prov_id", "seq", "fact_id", after=last).select("prov_id", "fact_id", "source_kind", "source_ref", "excerpt", now.alias("created_at"))
    return Graph(entities, facts, cut(graph.provenance.unionByName(evidence)))


def pruned(graph: Graph, paths: DataFrame, now: Column) -> Graph:
    """Closes current facts all of whose code lines are in files that their own repo no longer has. ``paths (repo, path)``: files of the repos that were scanned; other repos' facts stay."""
    stale = stale_facts(graph, paths)
    facts = graph.facts.join(stale.withColumnRenamed("fact_id", "stale_id"), F.col("fact_id") == F.col("stale_id"), "left").withColumn("valid_to", F.when(F.col("stale_id").isNotNull(), now.cast("timestamp")).otherwise(F.col("valid_to"))).drop("stale_id")
    return Graph(graph.entities, cut(facts), graph.provenance)


def stale_facts(graph: Graph, paths: DataFrame) -> DataFrame:
    """``(fact_id)`` of what ``pruned`` closes."""
    scanned = paths.select(F.col("repo").alias("scanned")).distinct()
    there = paths.select(F.col("repo").alias("there_repo"), F.col("path").alias("there_path")).distinct()
    refs = graph.provenance.where("source_kind = 'code_line'").select("fact_id", F.regexp_replace(F.regexp_replace("source_ref", "^code:", ""), ":[^:/]*$", "").alias("ref_path"))
    lines = graph.current().select("fact_id", "subject_id").join(refs, "fact_id").join(graph.entities.select(F.col("entity_id").alias("subject_id"), "repo"), "subject_id")
    own = lines.join(scanned, F.col("repo").eqNullSafe(F.col("scanned")), "left_semi")
    marked = own.join(there, F.col("repo").eqNullSafe(F.col("there_repo")) & (F.col("ref_path") == F.col("there_path")), "left")
    return marked.groupBy("fact_id").agg(F.count("there_path").alias("alive")).where("alive = 0").select("fact_id")
