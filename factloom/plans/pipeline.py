"""A whole build: files, tests, change logs and notes become a graph, which is merged, pruned, derived from and stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import cochange, derive
from factloom.operators.merge import Graph, consolidated, pruned
from factloom.plans.tables import cut, numbered
from factloom.schemas import CANDIDATES
from factloom.sources import changes, code, files, notes

DERIVED = ("der:inverse@1", "der:isa@1", "der:module@1", "der:reach@1", "der:may-raise@1", "der:tdepends@1")


def conform(df: DataFrame) -> DataFrame:
    """``df`` with all columns of candidates, in order; ``seq`` by content, so that a build is repeatable."""
    have = set(df.columns)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATES.fields if f.name != "seq"]
    return df.select(F.lit(0).cast("long").alias("seq"), *columns)


def sequenced(parts: list[DataFrame]) -> DataFrame:
    """All parts, one after the other, each in order of its content."""
    rows = reduce(DataFrame.unionByName, [conform(p).withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    keys = [c for c in CANDIDATES.names if c != "seq"]
    return numbered(rows.drop("seq"), "seq", "part", *keys).select(*CANDIDATES.names)


def cochange_candidates(lines: DataFrame, repo: str) -> DataFrame:
    both = cochange.facts(cochange.code_only(cochange.pairs(changes.commit_files(lines))))
    return both.select(F.lit("file").alias("subject_kind"), F.col("subject").alias("subject_name"), F.lit(repo).alias("subject_repo"), F.col("subject").alias("subject_path"), F.lit("co-changed-with").alias("predicate"), F.lit("file").alias("object_kind"), F.col("object").alias("object_name"), "confidence", F.lit("det:git-cochange@1").alias("extractor"), F.lit(f"git:{repo}").alias("origin"), F.concat(F.lit("together in "), F.col("support"), F.lit(" commits")).alias("excerpt"))


def build(graph: Graph, tree: DataFrame, now: Column, logs: dict[str, DataFrame] | None = None, notes_: DataFrame | None = None, derived: bool = True) -> Graph:
    """The graph after one build over ``tree (repo, path, source)``, change logs by repo, and ``notes (path, text)``.

    Facts of files that are gone are closed. Derived facts are derived anew: those that no longer follow are closed, and those that still do
    stay as they are. Building the same again changes nothing.
    """
    tree = cut(tree)
    parts = [code.code_facts(tree), code.tested_facts(tree, files.packages(tree))]
    parts += [cochange_candidates(lines, repo) for repo, lines in (logs or {}).items()]
    if notes_ is not None:
        parts.append(notes.lesson_facts(notes.note_sections(notes_)))
    graph = consolidated(graph, sequenced(parts), now)
    graph = pruned(graph, tree.select("repo", "path"), now)
    if not derived:
        return graph
    base = graph.facts.where(~F.col("extractor").isin(*DERIVED))
    first = cut(derive.all_derived(base, graph.entities))
    graph = rederived(graph, first, now, tuple(x for x in DERIVED if x != "der:tdepends@1"))
    return rederived(graph, cut(derive.second_round(graph.facts, graph.entities)), now, ("der:tdepends@1",))


def rederived(graph: Graph, derived: DataFrame, now: Column, extractors: tuple[str, ...]) -> Graph:
    """The graph with just ``derived`` among the current facts of these extractors: new ones are added, vanished ones closed, the rest isn't touched."""
    names = graph.entities.select("entity_id", "name", "repo")
    held = graph.current().where(F.col("extractor").isin(*extractors)).select("fact_id", "subject_id", "object_id", "predicate", "extractor")
    held = held.join(names.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("src"), "repo"), "subject_id").join(names.select(F.col("entity_id").alias("object_id"), F.col("name").alias("dst")), "object_id").select("fact_id", "src", "dst", "predicate", "repo", "extractor")
    held = cut(held)
    match = F.expr("d.src = h.src and d.dst = h.dst and d.predicate = h.predicate and d.repo <=> h.repo and d.extractor = h.extractor")
    gone = held.alias("h").join(derived.alias("d"), match, "left_anti").select(F.col("fact_id").alias("gone_id"))
    fresh = derived.alias("d").join(held.alias("h"), match, "left_anti")
    facts = graph.facts.join(gone, F.col("fact_id") == F.col("gone_id"), "left").withColumn("valid_to", F.when(F.col("gone_id").isNotNull(), now.cast("timestamp")).otherwise(F.col("valid_to"))).drop("gone_id")
    graph = Graph(graph.entities, cut(facts), graph.provenance)
    return consolidated(graph, sequenced([derive.as_candidates(fresh)]), now)
