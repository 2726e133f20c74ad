import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import cochange, derive
from factloom.plans import tables
from factloom.sources import changes


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [], "src string, dst string")


def got(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_closure_takes_shortest_depth_and_survives_cycles(spark):
    pairs = [("A", "B"), ("A", "C"), ("B", "E"), ("C", "D"), ("D", "E"), ("E", "A"), ("X", "X")]
    rows = got(derive.closure(edges(spark, pairs)), "src", "dst", "depth")
    assert ("A", "E", 2) in rows and not any(a == b for a, b, _ in rows)
    assert not any(d < 2 for *_, d in rows)


def test_closure_is_bounded_and_empty_on_nothing(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(20)]
    rows = got(derive.closure(edges(spark, chain), 3), "src", "dst", "depth")
    assert {d for *_, d in rows} == {2, 3}
    assert derive.closure(edges(spark, [])).count() == 0
    assert derive.closure(edges(spark, [("a", "b"), ("b", "a")])).count() == 0


def bfs(pairs, depth):
    """Sequential breadth-first search, neighbours in order of names."""
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    for src in sorted(out):
        seen, level = {src}, [(src,)]
        for d in range(1, depth + 1):
            new = []
            for path in level:
                for b in sorted(out.get(path[-1], ())):
                    if b not in seen:
                        seen.add(b)
                        new.append((*path, b))
                        yield src, b, d, (*path, b)
            level = new


@pytest.mark.parametrize("seed", range(4))
def test_reach_and_exceptions_equal_sequential_search(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(34)]
    raises = [(f"n{rnd.randrange(14)}", f"e{rnd.randrange(4)}") for _ in range(12)]
    found = list(bfs(pairs, 3))
    by_src, exceptions = defaultdict(list), defaultdict(list)
    for src, node, d, path in found:
        if d == 2:
            by_src[src].append((src, node, d, " -> ".join(path)))
        for e in sorted({e for n, e in raises if n == node}):
            if e not in {x[1] for x in exceptions[src]}:
                exceptions[src].append((src, e, d, " -> ".join(path)))
    df = edges(spark, pairs)
    assert got(derive.reaches(df, per_source=3), "src", "dst", "depth", "proof") == {r for rows in by_src.values() for r in rows[:3]}
    assert got(derive.may_raise(df, spark.createDataFrame(raises, "src string, exception string"), per_source=2), "src", "exception", "depth", "proof") == {r for rows in exceptions.values() for r in rows[:2]}
    dropped = {src: len(rows) - 3 for src, rows in by_src.items() if len(rows) > 3}
    assert dict(got(derive.truncated_sources(df, per_source=3), "src", "dropped")) == dropped


def test_inverse_turns_known_edges_only(spark):
    df = spark.createDataFrame([("calls", "a", "b", "r"), ("isa", "a", "b", "r")], "predicate string, src string, dst string, repo string")
    assert got(derive.inverse(df), "predicate", "src", "dst", "confidence") == {("called-by", "b", "a", 0.98)}


def test_inverse_has_no_cap(spark):
    df = spark.range(200_001).selectExpr("'calls' as predicate", "concat('a', id) as src", "'b' as dst", "'r' as repo")
    assert derive.inverse(df).count() == 200_001


def test_derivations_are_whole_unless_a_total_is_asked_for(spark):
    hops = spark.range(60_001).selectExpr("explode(array(named_struct('src', concat('a', id), 'dst', concat('b', id)), named_struct('src', concat('b', id), 'dst', concat('c', id)))) as e").select("e.*")
    assert derive.transitive_depends(hops).count() == 60_001
    assert derive.transitive_depends(hops, total=10).count() == 10
    raises = spark.range(80_001).selectExpr("'b' as src", "concat('e', id) as exception")
    assert derive.may_raise(edges(spark, [("a", "b")]), raises, per_source=None).count() == 80_001


def test_pairs_need_support_and_bounded_groups(spark):
    head = lambda k: f"{k:040x}"
    lines = [x for k in range(3) for x in (head(k), "a.py", "b.py", "")] + [head(9)] + [f"f{k}.py" for k in range(20)]
    log = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    rows = changes.commit_files(log)
    assert got(cochange.pairs(rows), "a", "b", "support") == {("a.py", "b.py", 3)}
    with pytest.raises(changes.LogError):
        changes.commit_files(spark.createDataFrame([(0, "a.py"), (1, head(1))], "n long, line string"))


def test_facts_go_both_ways_for_code_only(spark):
    pairs = spark.createDataFrame([("a.py", "b.py", 4), ("README.md", "a.py", 9)], "a string, b string, support long")
    rows = got(cochange.facts(cochange.code_only(pairs)), "subject", "object", "confidence")
    assert rows == {("a.py", "b.py", 0.7), ("b.py", "a.py", 0.7)}
    assert cochange.facts(pairs, cap=2).count() == 2  # a pair stays whole


def test_pairs_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Ten times the groups make ten times the tasks, and no more rows in any."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for groups in (500, 5000):
        rows = spark.range(groups).selectExpr("id as grp", "explode(array(id, id + 1, id + 1, null)) as item")
        pairs = cochange.pairs(rows, 1)
        assert pairs.count() == pairs.where("b = a + 1 and support = 1").count() == groups
        assert pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100
    spark.conf.set("spark.sql.adaptive.enabled", kept)
