from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import health, merge, query
from factloom.operators.store import Store, empty
from factloom.schemas import CANDIDATES


def candidate(seq, subject, predicate, value, confidence=0.8, extractor="llm:x@1", literal=True, origin="doc:n.md", repo=None, kind="symbol", object_kind="symbol"):
    return (seq, kind, subject, repo, None, predicate, None if literal else object_kind, None if literal else value, value if literal else None, confidence, extractor, origin, None)


def merged(spark, *batches):
    graph = empty(spark)
    for k, rows in enumerate(batches):
        graph = merge.consolidated(graph, spark.createDataFrame(rows, CANDIDATES), F.lit(datetime(2024, 1, k + 1)))
    return graph


def held(graph):
    return {(r.object_lit, r.confidence) for r in graph.current().collect()}


def test_corroboration_folds_and_never_reaches_certainty(spark):
    graph = merged(spark, [candidate(0, "s", "p", "v", 0.5)], [candidate(1, "s", "p", "v", 0.6), candidate(2, "s", "p", "v", 0.1)])
    assert held(graph) == {("v", round(0.72 + 0.28 * 0.3, 4))}
    assert max(c for _, c in held(merged(spark, [candidate(k, "s", "p", "v", 0.9) for k in range(12)]))) == 0.99
    assert held(merged(spark, [candidate(0, "s", "p", "v", 1.0, "det:x@1"), candidate(1, "s", "p", "v", 0.2)])) == {("v", 1.0)}
    assert graph.provenance.count() == 1


def test_single_values_are_superseded_by_what_is_as_strong(spark):
    graph = merged(spark, [candidate(0, "s", "supersedes", "a", 0.6)], [candidate(1, "s", "supersedes", "b", 0.6), candidate(2, "s", "supersedes", "c", 0.5)])
    assert held(graph) == {("b", 0.6)}
    old = graph.facts.where("object_lit = 'a'").first()
    assert old.valid_to == datetime(2024, 1, 2) and old.superseded_by == graph.facts.where("object_lit = 'b'").first().fact_id
    assert held(merged(spark, [candidate(0, "s", "supersedes", "a", 1.0, "det:x@1")], [candidate(1, "s", "supersedes", "b", 0.99)])) == {("a", 1.0)}


def test_a_value_that_comes_back_is_opened_again(spark):
    graph = merged(spark, [candidate(0, "s", "supersedes", "a", 0.6), candidate(1, "s", "supersedes", "b", 0.6), candidate(2, "s", "supersedes", "a", 0.7)])
    assert held(graph) == {("a", 0.6)} and graph.facts.count() == 2


def test_many_values_live_side_by_side_and_batches_are_repeatable(spark):
    rows = [candidate(k, "s", "p", v, extractor="det:x@1", literal=False) for k, v in enumerate("abca")]
    once, twice = merged(spark, rows), merged(spark, rows, rows)
    assert once.facts.count() == twice.facts.count() == 3 and twice.provenance.count() == 3
    assert once.entities.count() == 4


def test_null_repos_are_one_key(spark):
    graph = merged(spark, [candidate(0, "m", "p", "x"), candidate(1, "m", "p", "y"), candidate(2, "m", "p", "z", repo="r")])
    assert graph.entities.where("name = 'm'").count() == 2


def test_object_and_literal_exclude_each_other(spark):
    bad = list(candidate(0, "s", "p", "v"))
    bad[7] = "both"
    with pytest.raises(ValueError, match="exactly one"):
        merged(spark, [tuple(bad)])


def test_pruning_needs_all_lines_gone_and_a_scanned_repo(spark):
    rows = [candidate(k, s, "defined-in", "f.py", 1.0, "det:ast@1", origin=f"code:{path}:{k + 1}", repo=repo) for k, (s, path, repo) in enumerate([("gone", "old.py", "r"), ("moved", "old.py", "r"), ("moved", "new.py", "r"), ("other", "old.py", "q"), ("far", "old.py", None)])]
    graph = merged(spark, rows)
    paths = spark.createDataFrame([("r", "new.py"), ("q", "old.py")], "repo string, path string")
    after = merge.pruned(graph, paths, F.lit(datetime(2024, 2, 1)))
    names = {r.subject_name for r in query.named(after.current(), after.entities).collect()}
    assert names == {"moved", "other", "far"}


def test_time_travel_is_half_open(spark):
    graph = merged(spark, [candidate(0, "s", "supersedes", "a", 0.6)], [candidate(1, "s", "supersedes", "b", 0.9)])

    def at(day, second=0):
        return {r.object_lit for r in query.query_facts(graph, as_of=F.lit(datetime(2024, 1, day, 0, 0, second))).collect()}

    assert at(1) == {"a"} and at(2) == {"b"} and at(3) == {"b"}
    assert {r.object_lit for r in query.query_facts(graph, as_of=F.lit(datetime(2023, 1, 1))).collect()} == set()


def test_query_conditions_sources_and_dossier(spark):
    graph = merged(spark, [candidate(0, "a", "calls", "b", 0.9, literal=False, repo="r"), candidate(1, "a", "calls", "b", 0.9, literal=False, repo="r", origin="code:x.py:3"), candidate(2, "c", "calls", "a", 0.4, literal=False, repo="q"), candidate(3, "a", "note", "hi", 0.7)])
    row = query.query_facts(graph, obj="b").first()
    assert row.subject_name == "a" and row.sources == ["doc:n.md", "code:x.py:3"]
    assert query.query_facts(graph, obj="hi").count() == 1 and query.query_facts(graph, repo="q").count() == 0
    assert query.query_facts(graph, repo="q", min_confidence=0).count() == 1
    entity, out, into = query.explain_entity(graph, "a", "q")
    assert entity.count() == 1 and entity.first().repo == "q" and into.count() == 1 and out.count() == 0
    assert query.explain_entity(graph, "nobody")[0].count() == 0


def test_store_keeps_versions_and_batches_are_atomic(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    assert store.load() is None
    with store.batch() as held_:
        held_.graph = merged(spark, [candidate(0, "s", "p", "v")])
        with pytest.raises(RuntimeError), store.batch():
            pass
    version = store.version()
    with pytest.raises(KeyError), store.batch():
        raise KeyError
    assert store.version() == version and held(store.load()) == {("v", 0.8)}


def test_dashboard(spark):
    now = datetime(2024, 6, 1)
    old = datetime(2024, 1, 1)
    rows = [
        (1, 1, "calls", 2, None, 1.0, "det:ast@1", now, None),
        (2, 1, "calls", 2, None, 1.0, "det:ast@1", now, None),
        (3, 1, "prefers", None, "a", 0.9, "llm:x", now, None),
        (4, 1, "prefers", None, "b", 0.9, "llm:x", now, None),
        (5, 1, "thinks", None, "c", 0.8, "llm:x", old, None),
        (6, 9, "thinks", None, "d", 0.9, "llm:x", now, None),
        (7, 1, "thinks", None, "e", 0.9, "llm:x", now, now),
        (8, 1, "isa", 2, None, 0.9, "der:isa@1", old, None),
    ]
    facts = spark.createDataFrame(rows, "fact_id long, subject_id long, predicate string, object_id long, object_lit string, confidence double, extractor string, created_at timestamp, valid_to timestamp")
    names = spark.createDataFrame([(1, "s"), (2, "o"), (9, " ")], "entity_id long, name string")
    row = health.graph_health(facts, names, F.lit(now)).first()
    assert (row.live, row.superseded, row.det, row.der, row.inferred, row.dormant, row.contradictions, row.duplicates, row.orphans) == (7, 1, 2, 1, 4, 1, 1, 1, 1)
    assert "single values contradict each other" in row.warnings
    none = health.graph_health(facts.limit(0), names, F.lit(now)).first()
    assert none.live == 0 and none.warnings == []


def test_update_plan(spark):
    repos = spark.createDataFrame([("a", None, 0), ("b", 0, 0), ("c", 5, 3), ("d", 5, 0), ("e", 2, None)], "repo string, behind int, dirty int")
    assert {r.repo: r.action for r in health.update_plan(repos).collect()} == {"a": "skip-unknown", "b": "skip-fresh", "c": "skip-dirty", "d": "pull", "e": "skip-dirty"}
