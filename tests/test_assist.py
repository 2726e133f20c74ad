import io
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import assist, merge, query, rank, semantic
from factloom.operators.store import Store, empty
from factloom.plans import pipeline, rpc, tables
from factloom.plans.tables import cut, numbered
from factloom.schemas import CANDIDATES
from factloom.streaming.refresh import only_one, refresh

THEME = "def score_color(x):\n    return shade(x)\n\n\ndef shade(x):\n    raise KeyError\n\n\ndef top():\n    return score_color(1)\n"
NOTES = "# Lesson — theme colour\n**Every score colour must come from the one table of shades.** Why: two tables drifted apart.\n"


@pytest.fixture(scope="module")
def graph(spark):
    tree = spark.createDataFrame([("alpha", "app/theme.py", THEME), ("beta", "ui/colors.py", "def score_color(): pass\n"), ("alpha", "tests/test_theme.py", "from app.theme import score_color\ndef test_it():\n    score_color(2)\n")], "repo string, path string, source string")
    head = lambda k: f"{k:040x}"
    log = spark.createDataFrame(list(enumerate(x for k in range(3) for x in (head(k), "app/theme.py", "app/page.py"))), "n long, line string")
    notes = spark.createDataFrame([("n.md", NOTES)], "path string, text string")
    build = lambda g: pipeline.build(g, tree, F.lit("2024-01-01").cast("timestamp"), {"alpha": log}, notes)
    first = build(empty(spark))
    return first, build(first)


def test_build_derives_and_is_repeatable(graph):
    first, again = graph
    from factloom.operators.query import named

    rows = {(r.subject_name, r.predicate, r.object_name) for r in named(first.current(), first.entities).collect()}
    assert {("top", "reaches", "shade"), ("score_color", "may-raise", "KeyError"), ("top", "may-raise", "KeyError"), ("score_color", "called-by", "top"), ("test_it", "tests", "app.theme.score_color"), ("app/theme.py", "co-changed-with", "app/page.py")} <= rows
    key = lambda g: {(r.subject_id, r.predicate, r.object_id, r.object_lit, r.confidence, r.valid_to) for r in g.facts.collect()}
    assert key(first) == key(again)


def test_prompt_is_grounded_scoped_or_unchanged(spark, graph):
    task = "Change the score_color of the theme"
    prompt, report = assist.assist(spark, task, graph[0])
    assert "- `score_color` — app/theme.py:1 (called-by test_it, top; calls shade; co-changes-with app/page.py)" in prompt
    assert "Every score colour must come from" in prompt and prompt.endswith(task) and report["injected"] and assist.grounded_count(prompt) == report["grounded_symbols"]
    scoped, _ = assist.assist(spark, task, graph[0], repo="beta")
    assert "ui/colors.py" in scoped and "app/theme.py" not in scoped
    there = spark.createDataFrame([("ui/colors.py",)], "path string")
    assert "app/theme.py" not in assist.assist(spark, task, graph[0], workspace=there)[0]
    assert assist.assist(spark, "unrelated words entirely", graph[0]) == ("unrelated words entirely", {"injected": False, "grounded_symbols": 0, "lexical_hits": 0, "semantic_hits": 0})
    assert assist.assist(spark, task, None)[0] == task
    broken = merge.Graph(graph[0].entities, graph[0].facts.drop("predicate"), graph[0].provenance)
    assert assist.assist(spark, task, broken)[0] == task


def test_tools_and_rpc(spark, graph):
    g = graph[0]
    assert "top calls score_color" in assist.run_tool(g, "graph_query", {"predicate": "calls", "limit": "x"})
    assert assist.run_tool(g, "graph_query", {"subject": "nobody"}) == "no facts match that query"
    assert assist.run_tool(g, "graph_explain", {"name": "nobody"}) == "no facts: unknown entity"
    assert assist.run_tool(None, "graph_query", {}).startswith("memory graph unavailable")
    out = io.StringIO()
    lines = [json.dumps(x) for x in ({"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "graph_explain", "arguments": {"name": "top"}}}, {"id": 4, "method": "nope"}, [1])]
    rpc.serve(spark, g, [*lines, "{", ""], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0]["result"]["protocolVersion"] == "x" and len(replies[1]["result"]["tools"]) == 3
    assert "symbol top" in replies[2]["result"]["content"][0]["text"] and replies[3]["error"]["code"] == -32601
    assert [r["error"]["code"] for r in replies[4:]] == [-32600, -32700]


def embedder():
    def bag(texts):
        out = []
        for text in texts:
            v = [0.0] * 64
            for w in text.lower().replace("(", " ").split():
                v[sum(w.encode()) % 64] += 1
            out.append(v)
        return out

    return bag


def test_vectors_propose_and_index_skips_what_it_knows(spark, graph):
    g, bag = graph[0], embedder()
    symbols = g.entities.where("kind = 'symbol' and path is not null").select("entity_id", F.concat_ws(" ", "name", "path").alias("text"))
    none = spark.createDataFrame([], "entity_id long, model string, dim int, vec array<float>, src_hash string")
    index = cut(semantic.reindexed(none, symbols, bag, "m"))
    assert index.count() == symbols.count() and semantic.to_embed(symbols, index, "m").count() == 0 and semantic.to_embed(symbols, index, "other").count() == symbols.count()
    tasks = spark.createDataFrame([(7, "shade app/theme.py")], "task_id long, text string")
    best = semantic.proposed(tasks, index, g, bag, "m", 2).orderBy("place").first()
    assert (best["name"], best["path"], best["line"]) == ("shade", "app/theme.py", 5)


def test_cosine_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(rank, "BLOCK", 7)
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)] + [(99, [1.0]), (98, None)], "entity_id long, vec array<float>")
    got = {(r.query_id, r.place): r.entity_id for r in rank.cosine_top(df.withColumnRenamed("entity_id", "query_id"), df, 3).collect()}
    s = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 4)
    for q in range(40):
        assert [got[q, p] for p in (1, 2, 3)] == sorted(range(40), key=lambda k: (-s[q, k], k))[:3]
    assert got[99, 1] == 99


@pytest.mark.parametrize("wide", [True, False])
def test_cosine_by_bounded_tiles_keeps_ties_and_dimensions(spark, monkeypatch, wide):
    """Many groups a side, so tiles; equal vectors, whose order is by id; two dimensions."""
    import numpy as np

    monkeypatch.setattr(rank, "BLOCK", 3)
    monkeypatch.setattr(rank, "TILE", 20)
    rnd = np.random.default_rng(2)
    v = np.repeat(rnd.normal(size=(6, 4)), 5, axis=0).astype(np.float32)
    v[::7, 0] += 0.00004
    df = spark.createDataFrame([(k, [float(x) for x in (row if k % 3 else row[:2])]) for k, row in enumerate(v)], f"entity_id long, vec array<{'double' if wide else 'float'}>")
    answered = rank.cosine_top(df.withColumnRenamed("entity_id", "query_id"), df, 4)
    got = {(r.query_id, r.place): (r.entity_id, r.score) for r in answered.collect()}
    w = v.astype(float)
    for q in range(30):
        same = [k for k in range(30) if bool(k % 3) == bool(q % 3)]
        score = {k: round(float(w[q] @ w[k] if q % 3 else w[q, :2] @ w[k, :2]), 4) for k in same}
        assert [got[q, p][0] for p in (1, 2, 3, 4)] == sorted(same, key=lambda k: (-score[k], k))[:4]
    assert rank.cosine_top(df.limit(0).withColumnRenamed("entity_id", "query_id"), df, 4).count() == 0


def test_cosine_reads_a_bounded_part_a_task(spark, monkeypatch):
    """The rows of a group stay as many as they were when both sides are four times as large."""
    monkeypatch.setattr(rank, "BLOCK", 10)
    monkeypatch.setattr(rank, "TILE", 200)
    seen = []

    def of(n):
        df = spark.range(n).select(F.col("id").alias("entity_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
        seen.extend(n / k for k in rank._groups(df, df))
        return rank.cosine_top(df.withColumnRenamed("entity_id", "query_id"), df, 2)

    assert of(1000).where("place = 1 and entity_id = 0").count() == 1000
    of(4000)
    assert seen == [100] * 4


@pytest.fixture
def shuffled_joins(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_facts_without_object_dont_gather_in_one_task(spark, shuffled_joins, monkeypatch):
    ents = spark.range(4000).selectExpr("id as entity_id", "'k' as kind", "concat('n', id) as name", "cast(null as string) as repo")
    facts = spark.range(4000).selectExpr("id as fact_id", "id as subject_id", "if(id % 10 = 0, id + 1, null) as object_id")
    rows = query.named(facts, ents)
    assert rows.count() == 4000 and rows.where("object_name is not null").count() == 400
    assert rows.where("object_id is not null and object_name <> concat('n', object_id)").count() == 0
    assert largest_task(rows) < 1500
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    assert largest_task(query.named(facts, ents)) < 200  # more rows have more tasks


def test_sources_of_many_facts_are_found_in_small_tasks(spark, shuffled_joins, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    told = spark.range(8000).selectExpr("id as prov_id", "id div 2 as fact_id", "concat('s', id) as source_ref")
    rows = query.with_sources(spark.range(4000).selectExpr("id as fact_id"), told)
    assert rows.where("sources = array(concat('s', fact_id * 2), concat('s', fact_id * 2 + 1))").count() == 4000
    assert largest_task(rows.where("size(sources) = 2")) < 200


def test_key_of_a_fact_without_object_is_no_entity(spark):
    """Even if an entity has that number, a fact without an object has none."""
    key = spark.range(1).select(F.xxhash64(F.lit(5).cast("long"), F.lit(1).cast("long"))).first()[0]
    ents = spark.createDataFrame([(1, "order", "a", None), (key, "nation", "b", None)], "entity_id long, kind string, name string, repo string")
    facts = spark.createDataFrame([(5, 1, None), (6, 1, key)], "fact_id long, subject_id long, object_id long")
    assert {(r.fact_id, r.object_kind) for r in query.named(facts, ents).collect()} == {(5, None), (6, "nation")}


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    assert [(r.x, r.n) for r in numbered(df, "n", "x", after=5).orderBy("x").collect()] == [(k, k + 6) for k in range(100)]


def test_refresh_and_lock(spark, tmp_path):
    rows = [(k, "symbol", f"s{k}", None, None, "p", None, None, "v", 0.8, "llm:x@1", "doc:n", None) for k in range(3)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, CANDIDATES).write.parquet(source)
    store = Store(spark, str(tmp_path / "g"))
    for _ in range(2):
        refresh(store, spark.readStream.schema(CANDIDATES).parquet(source), str(tmp_path / "check")).awaitTermination()
    assert store.load().current().count() == 3
    with only_one(str(tmp_path / "lock")) as a, only_one(str(tmp_path / "lock")) as b:
        assert a and not b
