"""Registered queries of the graph's operators, on projections of the relational, event and text tables, with the same in DuckDB's SQL.

Parts that are bought in one order play files that change in one commit; customers form a tree of keys; events assert and retract values over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators import cochange, derive, entities, health, merge, query, rank, semantic
from factloom.plans.tables import spread
from factloom.sources import changes, code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-03-01 00:00:00"


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.to_timestamp(F.lit(NOW)).cast("timestamp_ntz")


# what changes together

_SETS = "WITH g AS (SELECT l_orderkey AS grp, list(DISTINCT l_partkey) AS items FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1), x AS (SELECT grp, unnest(items) AS item FROM g WHERE len(items) BETWEEN 2 AND 12), pairs AS (SELECT a.item AS a, b.item AS b, count(*) AS support FROM x a JOIN x b ON a.grp = b.grp AND a.item < b.item GROUP BY ALL)"
_GRAPH = f"{_SETS}, e AS (SELECT a AS src, b AS dst FROM pairs WHERE support >= 2)"


def part_groups(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("item"))


def part_graph(spark, sf_dir) -> DataFrame:
    return cochange.pairs(part_groups(spark, sf_dir), 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))


@registered(f"{_SETS} SELECT a, b, support FROM pairs WHERE support >= 3")
def cochange_pairs(spark, sf_dir):
    return cochange.pairs(part_groups(spark, sf_dir))


@registered(f"{_SETS}, top AS (SELECT * FROM pairs WHERE support >= 3 ORDER BY support DESC, a, b LIMIT 25000) SELECT a AS subject, b AS object, round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * support), 4) AS confidence, support FROM top UNION ALL SELECT b, a, round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * support), 4), support FROM top")
def cochange_facts(spark, sf_dir):
    return cochange.facts(cochange.pairs(part_groups(spark, sf_dir)))


# a graph of facts: orders placed by customers, in nations, in regions; order priorities as literals

_ENTITIES = """WITH e0 AS (
SELECT 1000000000 + c_custkey AS entity_id, 'customer' AS kind, c_name AS name, c_mktsegment AS repo FROM customer
UNION ALL SELECT 2000000000 + n_nationkey, 'nation', n_name, NULL FROM nation
UNION ALL SELECT 3000000000 + r_regionkey, 'region', r_name, NULL FROM region
UNION ALL SELECT 4000000000 + o_orderkey, 'order', 'order-' || o_orderkey::VARCHAR, NULL FROM orders),
f0 AS (
SELECT 1000000000 + c_custkey AS fact_id, 1000000000 + c_custkey AS subject_id, 'lives-in' AS predicate, 2000000000 + c_nationkey AS object_id, NULL::VARCHAR AS object_lit, round(0.3::DOUBLE + (c_custkey % 7)::DOUBLE / 10, 4) AS confidence, CASE WHEN c_custkey % 3 = 0 THEN 'det:crm@1' ELSE 'llm:guess@1' END AS extractor, TIMESTAMP '2023-11-01 00:00:00' + to_days((c_custkey % 100)::INTEGER) AS valid_from, NULL::TIMESTAMP AS valid_to FROM customer
UNION ALL SELECT 2000000000 + n_nationkey, 2000000000 + n_nationkey, 'part-of', 3000000000 + n_regionkey, NULL, 1.0, 'det:map@1', TIMESTAMP '2023-11-01 00:00:00', NULL FROM nation
UNION ALL SELECT 4000000000 + o_orderkey, 4000000000 + o_orderkey, 'placed-by', 1000000000 + o_custkey, NULL, 0.95, 'det:shop@1', o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END FROM orders
UNION ALL SELECT 5000000000 + o_orderkey, 4000000000 + o_orderkey, 'has-priority', NULL, o_orderpriority, 0.7, 'llm:mail@1', o_orderdate, NULL FROM orders),
n0 AS (SELECT f.*, s.kind AS subject_kind, s.name AS subject_name, s.repo AS subject_repo, o.kind AS object_kind, o.name AS object_name FROM f0 f JOIN e0 s ON f.subject_id = s.entity_id LEFT JOIN e0 o ON f.object_id = o.entity_id)"""
_SHOWN = "fact_id, subject_name, predicate, object_name, object_lit, confidence"


def shop(spark, sf_dir) -> merge.Graph:
    none = F.lit(None)
    c, n, r, o = (t(spark, sf_dir, x) for x in ("customer", "nation", "region", "orders"))
    at = lambda base, key: (F.lit(base).cast("long") + F.col(key)).cast("long")
    start = F.to_timestamp(F.lit("2023-11-01 00:00:00")).cast("timestamp_ntz")
    ents = c.select(at(1_000_000_000, "c_custkey").alias("entity_id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("repo"))
    ents = ents.unionAll(n.select(at(2_000_000_000, "n_nationkey"), F.lit("nation"), "n_name", none.cast("string"))).unionAll(r.select(at(3_000_000_000, "r_regionkey"), F.lit("region"), "r_name", none.cast("string")))
    ents = ents.unionAll(o.select(at(4_000_000_000, "o_orderkey"), F.lit("order"), F.concat(F.lit("order-"), F.col("o_orderkey")), none.cast("string"))).withColumn("path", none.cast("string"))
    lit, obj = none.cast("string"), none.cast("long")
    facts = c.select(at(1_000_000_000, "c_custkey").alias("fact_id"), at(1_000_000_000, "c_custkey").alias("subject_id"), F.lit("lives-in").alias("predicate"), at(2_000_000_000, "c_nationkey").alias("object_id"), lit.alias("object_lit"), F.round(F.lit(0.3) + (F.col("c_custkey") % 7).cast("double") / 10, 4).alias("confidence"), F.when(F.col("c_custkey") % 3 == 0, "det:crm@1").otherwise("llm:guess@1").alias("extractor"), (start + F.make_dt_interval((F.col("c_custkey") % 100).cast("int"))).alias("valid_from"), none.cast("timestamp_ntz").alias("valid_to"))
    facts = facts.unionAll(n.select(at(2_000_000_000, "n_nationkey"), at(2_000_000_000, "n_nationkey"), F.lit("part-of"), at(3_000_000_000, "n_regionkey"), lit, F.lit(1.0), F.lit("det:map@1"), start, none.cast("timestamp_ntz")))
    ordered = F.col("o_orderdate").cast("timestamp_ntz")
    facts = facts.unionAll(o.select(at(4_000_000_000, "o_orderkey"), at(4_000_000_000, "o_orderkey"), F.lit("placed-by"), at(1_000_000_000, "o_custkey"), lit, F.lit(0.95), F.lit("det:shop@1"), ordered, F.when(F.col("o_orderstatus") == "F", ordered + F.expr("interval 90 days"))))
    facts = facts.unionAll(o.select(at(5_000_000_000, "o_orderkey"), at(4_000_000_000, "o_orderkey"), F.lit("has-priority"), obj, "o_orderpriority", F.lit(0.7), F.lit("llm:mail@1"), ordered, none.cast("timestamp_ntz"))).withColumn("created_at", F.col("valid_from")).withColumn("superseded_by", obj)
    sources = o.select(at(4_000_000_000, "o_orderkey").alias("prov_id"), at(4_000_000_000, "o_orderkey").alias("fact_id"), F.lit("doc").alias("source_kind"), F.concat(F.lit("orders:"), F.col("o_orderkey")).alias("source_ref"), lit.alias("excerpt"), ordered.alias("created_at"))
    sources = sources.unionAll(o.select(at(6_000_000_000, "o_orderkey"), at(4_000_000_000, "o_orderkey"), F.lit("derived"), F.concat(F.lit("status:"), F.col("o_orderstatus")), lit, ordered))
    return merge.Graph(ents, facts, sources)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("fact_id", "subject_name", "predicate", "object_name", "object_lit", "confidence")


@registered(f"{_ENTITIES} SELECT {_SHOWN}, CASE WHEN predicate = 'placed-by' THEN 'orders:' || (fact_id - 4000000000)::VARCHAR || ',status:' || (SELECT o_orderstatus FROM orders WHERE o_orderkey = fact_id - 4000000000) ELSE '' END AS sources FROM n0 WHERE valid_to IS NULL AND confidence >= 0.9 AND predicate = 'placed-by'")
def facts_filter(spark, sf_dir):
    found = query.query_facts(shop(spark, sf_dir), predicate="placed-by", min_confidence=0.9, limit=None)
    return found.select("fact_id", "subject_name", "predicate", "object_name", "object_lit", "confidence", F.array_join("sources", ",").alias("sources"))


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND confidence >= 0.5 ORDER BY confidence DESC, valid_from DESC, fact_id LIMIT 50")
def facts_top(spark, sf_dir):
    return _shown(query.query_facts(shop(spark, sf_dir)))


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND confidence >= 0.5 AND (object_name = '1-URGENT' OR object_lit = '1-URGENT')")
def facts_object_or_literal(spark, sf_dir):
    return _shown(query.query_facts(shop(spark, sf_dir), obj="1-URGENT", limit=None))


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND confidence >= 0.5 AND (subject_kind = 'nation' OR object_kind = 'nation')")
def facts_kind(spark, sf_dir):
    return _shown(query.query_facts(shop(spark, sf_dir), kind="nation", limit=None))


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND confidence >= 0.5 AND subject_repo = 'BUILDING'")
def facts_repo(spark, sf_dir):
    return _shown(query.query_facts(shop(spark, sf_dir), repo="BUILDING", limit=None))


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_from <= TIMESTAMP '1996-06-30 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30 00:00:00') AND confidence >= 0.5")
def facts_asof(spark, sf_dir):
    moment = F.to_timestamp(F.lit("1996-06-30 00:00:00")).cast("timestamp_ntz")
    return _shown(query.query_facts(shop(spark, sf_dir), as_of=moment, limit=None))


_WHO = "(SELECT entity_id FROM e0 WHERE name = (SELECT min(n_name) FROM nation) ORDER BY entity_id LIMIT 1)"


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND subject_id = {_WHO}")
def explain_out(spark, sf_dir):
    name = t(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _shown(query.explain_entity(shop(spark, sf_dir), name)[1])


@registered(f"{_ENTITIES} SELECT {_SHOWN} FROM n0 WHERE valid_to IS NULL AND object_id = {_WHO} ORDER BY confidence DESC, valid_from DESC, fact_id LIMIT 200")
def explain_in(spark, sf_dir):
    name = t(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _shown(query.explain_entity(shop(spark, sf_dir), name)[2])


@registered(f"{_ENTITIES} SELECT predicate, count(*) AS facts FROM f0 WHERE valid_to IS NULL GROUP BY predicate")
def predicate_census(spark, sf_dir):
    return query.predicate_census(shop(spark, sf_dir).facts)


@registered(f"{_ENTITIES} SELECT fact_id, round(CASE WHEN extractor LIKE 'det:%' THEN confidence ELSE round(confidence * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, date_diff('second', valid_from, TIMESTAMP '{NOW}')::DOUBLE / 86400) / 60), 4) END, 4) AS worth FROM f0")
def effective_confidence(spark, sf_dir):
    f = shop(spark, sf_dir).facts
    return f.select("fact_id", F.round(confidence.effective(F.col("confidence"), F.col("created_at"), now(), F.col("extractor")), 4).alias("worth"))


# entities

_MENTIONS = "WITH m AS (SELECT 'customer' AS kind, c_mktsegment AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'n' || (c_nationkey % 5)::VARCHAR END AS repo, CASE WHEN c_custkey % 4 = 3 THEN 'p' || (c_custkey % 11)::VARCHAR END AS path, c_custkey AS seq FROM customer)"


def mentions(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey") % 5)).alias("repo"), F.when(key % 4 == 3, F.concat(F.lit("p"), key % 11)).alias("path"), key.alias("seq"))


@registered(f"{_MENTIONS} SELECT kind, name, repo, arg_min(path, seq) FILTER (WHERE path IS NOT NULL) AS path, count(*) AS mentions FROM m GROUP BY ALL")
def entity_nullsafe_dedupe(spark, sf_dir):
    return entities.distinct_keys(mentions(spark, sf_dir))


@registered(f"{_MENTIONS}, old AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS entity_id, 'customer' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || (n_nationkey % 5)::VARCHAR || CASE WHEN n_nationkey >= 10 THEN 'x' ELSE '' END END AS repo FROM nation), f AS (SELECT kind, name, repo, arg_min(path, seq) FILTER (WHERE path IS NOT NULL) AS path, min(seq) AS seq FROM m GROUP BY ALL) SELECT o.entity_id, o.kind, o.name, o.repo, f.path FROM old o LEFT JOIN f ON o.kind = f.kind AND o.name = f.name AND o.repo IS NOT DISTINCT FROM f.repo UNION ALL SELECT 25 + row_number() OVER (ORDER BY seq), kind, name, repo, path FROM f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.kind = f.kind AND o.name = f.name AND o.repo IS NOT DISTINCT FROM f.repo)")
def entity_upsert_backfill(spark, sf_dir):
    key = F.col("n_nationkey")
    even = key % 2 == 0
    none = F.lit(None)
    old = t(spark, sf_dir, "nation").select((F.row_number().over(Window.orderBy(key))).cast("long").alias("entity_id"), F.lit("customer").alias("kind"), F.when(even, "BUILDING").otherwise(F.col("n_name")).alias("name"), F.when(even, F.concat(F.lit("n"), key % 5, F.when(key >= 10, "x").otherwise(""))).alias("repo"), none.cast("string").alias("path"), none.cast("string").alias("meta"), none.cast("timestamp").alias("first_seen"), none.cast("timestamp").alias("last_seen"))
    return entities.upserted(old, mentions(spark, sf_dir), F.current_timestamp()).select("entity_id", "kind", "name", "repo", "path")


# derivations


@registered("SELECT DISTINCT 'supplied-by' AS predicate, p_name AS src, s_name AS dst, 0.98::DOUBLE AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_name <> '' AND p_name <> ''")
def inverse_edges(spark, sf_dir):
    l, s, p = (t(spark, sf_dir, x) for x in ("lineitem", "supplier", "part"))
    rows = l.count()
    known = spread(l, rows, "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    known = spread(known, rows, "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).where("s_name <> '' and p_name <> ''")
    edges = known.select(F.lit("supplies").alias("predicate"), F.col("s_name").alias("src"), F.col("p_name").alias("dst"), F.lit(None).cast("string").alias("repo"))
    edges = spread(edges, rows, "src", "dst").distinct()
    return derive.inverse(edges, {"supplies": "supplied-by"}).select("predicate", "src", "dst", "confidence").distinct()


@registered("WITH RECURSIVE r(src, dst, depth) AS (SELECT c_custkey, c_custkey // 3, 1 FROM customer WHERE c_custkey <> c_custkey // 3 UNION ALL SELECT r.src, r.dst // 3, depth + 1 FROM r WHERE depth < 8 AND r.dst <> r.dst // 3) SELECT src, dst, depth, round(0.95::DOUBLE * pow(0.9::DOUBLE, depth - 2), 4) AS confidence FROM r WHERE depth > 1")
def closure_isa(spark, sf_dir):
    key = F.col("c_custkey")
    return derive.isa(t(spark, sf_dir, "customer").select(key.alias("src"), F.expr("c_custkey div 3").alias("dst")))


_TWO = f"{_GRAPH}, far AS (SELECT a.src, b.dst, min([a.src, a.dst, b.dst]) AS path FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = a.src AND x.dst = b.dst) GROUP BY a.src, b.dst)"


@registered(f"{_TWO} SELECT src, dst, 2 AS depth, 0.81::DOUBLE AS confidence, array_to_string(path, ' -> ') AS proof FROM far")
def reaches(spark, sf_dir):
    return derive.reaches(part_graph(spark, sf_dir), per_source=None, total=None)


@registered(f"{_TWO} SELECT src, dst, 2 AS depth, 0.81::DOUBLE AS confidence, array_to_string(path, ' -> ') AS proof FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY path) AS n FROM far) WHERE n <= 10")
def reaches_capped(spark, sf_dir):
    return derive.reaches(part_graph(spark, sf_dir), total=None)


@registered(f"{_TWO} SELECT src, count(*) AS found, count(*) - 10 AS dropped FROM far GROUP BY src HAVING count(*) > 10")
def reaches_truncated(spark, sf_dir):
    return derive.truncated_sources(part_graph(spark, sf_dir))


@registered(f"""{_GRAPH}, r AS (SELECT DISTINCT l_partkey AS node, 'code-' || (l_suppkey % 40)::VARCHAR AS exception FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1),
d1 AS (SELECT src, dst AS node, 1 AS depth, [src, dst] AS path FROM e),
d2 AS (SELECT d.src, e.dst AS node, 2 AS depth, min(list_append(d.path, e.dst)) AS path FROM d1 d JOIN e ON d.node = e.src WHERE e.dst <> d.src AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.src = d.src AND x.node = e.dst) GROUP BY d.src, e.dst),
d12 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
d3 AS (SELECT d.src, e.dst AS node, 3 AS depth, min(list_append(d.path, e.dst)) AS path FROM d2 d JOIN e ON d.node = e.src WHERE e.dst <> d.src AND NOT EXISTS (SELECT 1 FROM d12 x WHERE x.src = d.src AND x.node = e.dst) GROUP BY d.src, e.dst),
met AS (SELECT d.src, r.exception, d.depth, d.path, row_number() OVER (PARTITION BY d.src, r.exception ORDER BY d.depth, d.path) AS k FROM (SELECT * FROM d12 UNION ALL SELECT * FROM d3) d JOIN r ON d.node = r.node),
best AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY depth, path, exception) AS n FROM met WHERE k = 1)
SELECT src, exception, depth, round(pow(0.9::DOUBLE, depth), 4) AS confidence, array_to_string(path, ' -> ') AS proof FROM best WHERE n <= 20""")
def may_raise(spark, sf_dir):
    raised = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.1").select(F.col("l_partkey").alias("src"), F.concat(F.lit("code-"), F.col("l_suppkey") % 40).alias("exception"))
    return derive.may_raise(part_graph(spark, sf_dir), raised, total=None)


_LIFTED = f"{_GRAPH}, lifted AS (SELECT a.p_brand AS src, b.p_brand AS dst, count(*) AS support FROM e JOIN part a ON e.src = a.p_partkey JOIN part b ON e.dst = b.p_partkey WHERE a.p_brand <> b.p_brand AND a.p_brand <> '' AND b.p_brand <> '' GROUP BY ALL)"


def brand_edges(spark, sf_dir) -> DataFrame:
    p = t(spark, sf_dir, "part")
    named = part_graph(spark, sf_dir).join(p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_path")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("dst_path")), "dst")
    return derive.module_depends(named.withColumn("repo", F.lit("parts")))


@registered(f"{_LIFTED} SELECT src, dst, support, 'parts' AS repo FROM lifted")
def module_depends(spark, sf_dir):
    return brand_edges(spark, sf_dir)


@registered("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand || '/' || (p_size % 10)::VARCHAR AS src, p_brand || '/' || ((p_size * 7 + 3) % 10)::VARCHAR AS dst FROM part),
r(src, dst, depth, path) AS (SELECT src, dst, 1, [src, dst] FROM e WHERE src <> dst UNION ALL SELECT r.src, e.dst, depth + 1, list_append(path, e.dst) FROM r JOIN e ON r.dst = e.src WHERE depth < 5 AND NOT list_contains(path, e.dst))
SELECT src, dst, min(depth) AS depth, round(pow(0.9::DOUBLE, min(depth)), 4) AS confidence FROM r GROUP BY src, dst HAVING min(depth) > 1""")
def tdepends(spark, sf_dir):
    node = lambda e: F.concat(F.col("p_brand"), F.lit("/"), e)
    edges = t(spark, sf_dir, "part").select(node(F.col("p_size") % 10).alias("src"), node((F.col("p_size") * 7 + 3) % 10).alias("dst"))
    return derive.transitive_depends(edges)


# merging



def offers(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), (F.floor("value") % 3).cast("long").alias("object_id"), F.lit(None).cast("string").alias("object_lit"), F.col("event_id").alias("seq"), F.round(F.lit(0.3) + (F.col("event_id") % 5).cast("double") / 10, 4).alias("confidence"), F.lit("llm:x@1").alias("extractor"))


def _nothing(spark) -> DataFrame:
    return spark.createDataFrame([], "fact_id long, subject_id long, predicate string, object_id long, object_lit string, confidence double, extractor string")


@registered("""WITH c AS (SELECT user_id AS subject_id, event_type AS predicate, (floor(value)::BIGINT % 3)::BIGINT AS object_id, event_id AS seq, round(0.3::DOUBLE + (event_id % 5)::DOUBLE / 10, 4) AS confidence FROM events),
l AS (SELECT subject_id, predicate, object_id, list(confidence ORDER BY seq) AS cs FROM c GROUP BY ALL)
SELECT subject_id, predicate, object_id, list_reduce(cs, lambda a, b: round(least(0.99::DOUBLE, greatest(a, b) + (1.0::DOUBLE - greatest(a, b)) * 0.3::DOUBLE), 4)) AS confidence, 1 AS added, (len(cs) - 1)::INTEGER AS merged FROM l""")
def consolidate_merge(spark, sf_dir):
    key = ["subject_id", "predicate", "object_id"]
    return merge.merged_values(_nothing(spark), offers(spark, sf_dir), key).select(*key, "confidence", "added", "merged")


@registered("""WITH RECURSIVE c AS (SELECT user_id AS subject_id, event_type AS predicate, (floor(value)::BIGINT % 3)::BIGINT AS object_id, round(0.3::DOUBLE + (event_id % 5)::DOUBLE / 10, 4) AS confidence, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
s(subject_id, predicate, n, held, worth, first_worth) AS (
SELECT subject_id, predicate, n, object_id, confidence, MAP {object_id: confidence} FROM c WHERE n = 1
UNION ALL SELECT s.subject_id, s.predicate, c.n,
CASE WHEN c.object_id = s.held OR c.confidence < s.worth THEN s.held ELSE c.object_id END,
CASE WHEN c.object_id = s.held THEN round(least(0.99::DOUBLE, greatest(s.worth, c.confidence) + (1.0::DOUBLE - greatest(s.worth, c.confidence)) * 0.3::DOUBLE), 4) WHEN c.confidence < s.worth THEN s.worth WHEN map_contains(s.first_worth, c.object_id) THEN s.first_worth[c.object_id] ELSE c.confidence END,
CASE WHEN c.object_id = s.held THEN map_concat(s.first_worth, MAP {c.object_id: round(least(0.99::DOUBLE, greatest(s.worth, c.confidence) + (1.0::DOUBLE - greatest(s.worth, c.confidence)) * 0.3::DOUBLE), 4)}) WHEN c.confidence < s.worth OR map_contains(s.first_worth, c.object_id) THEN s.first_worth ELSE map_concat(s.first_worth, MAP {c.object_id: c.confidence}) END
FROM s JOIN c ON s.subject_id = c.subject_id AND s.predicate = c.predicate AND c.n = s.n + 1)
SELECT subject_id, predicate, held AS object_id, worth AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY subject_id, predicate ORDER BY n DESC) = 1""")
def consolidate_supersede(spark, sf_dir):
    return merge.resolved_slots(_nothing(spark), offers(spark, sf_dir)).where("current").select("subject_id", "predicate", "object_id", "confidence")


@registered("SELECT DISTINCT o_orderkey AS fact_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') AND o_orderstatus <> 'P'")
def prune_stale(spark, sf_dir):
    o, lines = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    none = F.lit(None)
    path = F.concat(F.lit("o/"), F.col("o_orderkey"))
    graph = merge.Graph(
        o.select(F.col("o_orderkey").alias("entity_id"), F.lit("symbol").alias("kind"), path.alias("name"), F.when(F.col("o_orderstatus") == "P", "unscanned").otherwise("scanned").alias("repo"), path.alias("path")),
        o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("subject_id"), F.lit("x").alias("predicate"), none.cast("timestamp").alias("valid_to")),
        o.select(F.col("o_orderkey").alias("fact_id"), F.lit("code_line").alias("source_kind"), F.concat(F.lit("code:"), path, F.lit(":7")).alias("source_ref")),
    )
    there = lines.where("l_returnflag <> 'R'").select(F.lit("scanned").alias("repo"), F.concat(F.lit("o/"), F.col("l_orderkey")).alias("path")).distinct()
    return merge.stale_facts(graph, there)


_VERSIONS = f"WITH f AS (SELECT event_id AS fact_id, user_id AS subject_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'prefers' ELSE event_type END AS predicate, (floor(value)::BIGINT % 4)::BIGINT AS object_id, round(0.3::DOUBLE + (event_id % 7)::DOUBLE / 10, 4) AS confidence, CASE event_id % 3 WHEN 0 THEN 'det:a@1' WHEN 1 THEN 'der:b@1' ELSE 'llm:c@1' END AS extractor, ts AS created_at, CASE WHEN event_id % 10 = 0 THEN ts END AS valid_to FROM events), live AS (SELECT * FROM f WHERE valid_to IS NULL), w AS (SELECT *, round(confidence * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, date_diff('second', created_at, TIMESTAMP '{NOW}')::DOUBLE / 86400) / 60), 4) AS worth FROM live WHERE extractor LIKE 'llm:%')"


def versions(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    least = e.agg(F.min("event_type")).first()[0]
    key = F.col("event_id")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(key.alias("fact_id"), F.col("user_id").alias("subject_id"), F.when(F.col("event_type") == least, "prefers").otherwise(F.col("event_type")).alias("predicate"), (F.floor("value") % 4).cast("long").alias("object_id"), F.lit(None).cast("string").alias("object_lit"), F.round(F.lit(0.3) + (key % 7).cast("double") / 10, 4).alias("confidence"), F.when(key % 3 == 0, "det:a@1").when(key % 3 == 1, "der:b@1").otherwise("llm:c@1").alias("extractor"), ts.alias("created_at"), F.when(key % 10 == 0, ts).alias("valid_to"))


@registered(f"""{_VERSIONS} SELECT (SELECT count(*) FROM live) AS live, (SELECT count(*) FROM f WHERE valid_to IS NOT NULL) AS superseded,
(SELECT count(*) FROM live WHERE extractor LIKE 'det:%') AS det, (SELECT count(*) FROM live WHERE extractor LIKE 'der:%') AS der, (SELECT count(*) FROM w) AS inferred, (SELECT count(*) FROM w WHERE worth < 0.5) AS dormant,
(SELECT count(*) FROM (SELECT 1 FROM live WHERE predicate = 'prefers' GROUP BY subject_id HAVING count(DISTINCT object_id) > 1)) AS contradictions,
(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM live GROUP BY subject_id, predicate, object_id)) AS duplicates,
(SELECT count(*) FROM live WHERE subject_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) AS orphans""")
def health_dashboard(spark, sf_dir):
    named = t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return health.graph_health(versions(spark, sf_dir), named, now()).drop("oldest", "newest", "warnings")


@registered("WITH r AS (SELECT user_id::VARCHAR AS repo, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) % 4 END AS behind, count(*) FILTER (WHERE value > 90) % 2 AS dirty FROM events GROUP BY user_id) SELECT repo, behind, dirty, CASE WHEN behind IS NULL THEN 'skip-unknown' WHEN behind = 0 THEN 'skip-fresh' WHEN dirty <> 0 THEN 'skip-dirty' ELSE 'pull' END AS action FROM r")
def watch_plan(spark, sf_dir):
    repos = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("high"))
    return health.update_plan(repos.select(F.col("user_id").cast("string").alias("repo"), F.when(F.col("n") % 5 != 0, F.col("n") % 4).alias("behind"), (F.col("high") % 2).alias("dirty")))


# text

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_SPELT = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SPELLINGS.items()) + " ELSE w END"


def terms_sql(expr: str) -> str:
    listed = f"list_concat(regexp_extract_all(lower({expr}), '[a-z][a-z0-9]*(?:_[a-z0-9]+)+'), regexp_extract_all(lower({expr}), '[a-z]{{3,}}'))"
    return f"list_filter(list_transform({listed}, lambda w: {_SPELT}), lambda w: w NOT IN ({_STOP}))"


@registered(f"WITH x AS (SELECT doc_id AS task_id, unnest({terms_sql('text')}) AS w, generate_subscripts({terms_sql('text')}, 1) AS k FROM documents), f AS (SELECT task_id, w, min(k) AS k FROM x GROUP BY ALL) SELECT d.doc_id AS task_id, coalesce(string_agg(w, ' ' ORDER BY k), '') AS terms FROM documents d LEFT JOIN f ON d.doc_id = f.task_id GROUP BY d.doc_id")
def task_terms(spark, sf_dir):
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.array_join(text.terms(F.col("text")), " ").alias("terms"))


@registered("SELECT doc_id, md5(text || ' the colors, greyish gray ' || doc_id || ' CENTREd center. recolour') AS folded FROM documents")
def fold_terms(spark, sf_dir):
    """Spellings inside a text; none of the documents' own words is one of those."""
    spelt = F.concat("text", F.lit(" the colours, greyish GREY "), "doc_id", F.lit(" CENTREd centre. recolour"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded(spelt)).alias("folded"))


@registered(f"""WITH b AS (SELECT item_id, text || ' ' || p_type || ' ' || p_brand AS text FROM benchmark JOIN part ON p_partkey = item_id + 1), q AS (SELECT item_id AS task_id, list_distinct({terms_sql('text')}) AS ts FROM b),
s AS (SELECT DISTINCT lower(p_type) || ' ' || lower(p_name) AS name, CASE WHEN p_size % 5 = 0 THEN 'tests/' WHEN p_size % 5 = 1 THEN 'a/docs/' ELSE 'src/' END || lower(p_brand) || '.py' AS path FROM part),
x AS (SELECT task_id, s.name, s.path, list_sum(list_transform(ts, lambda w: (CASE WHEN contains(s.name, w) THEN 2 ELSE 0 END) + (CASE WHEN contains(string_split(s.path, '/')[-1], w) THEN 1 ELSE 0 END)))::INTEGER AS score FROM q, s),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name, path) AS place FROM x WHERE score >= 3 AND path LIKE 'src/%')
SELECT task_id, name, path, score, place FROM r WHERE place <= 5""")
def lexical_rank(spark, sf_dir):
    """Tasks that name a part's kind among other words; symbols of tests and documents don't count."""
    of = t(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("item_id"), "p_type", "p_brand")
    tasks = t(spark, sf_dir, "benchmark").join(of, "item_id").select(F.col("item_id").alias("task_id"), F.concat_ws(" ", "text", "p_type", "p_brand").alias("text"))
    folder = F.when(F.col("p_size") % 5 == 0, "tests/").when(F.col("p_size") % 5 == 1, "a/docs/").otherwise("src/")
    symbols = t(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_name")).alias("name"), F.concat(folder, F.lower("p_brand"), F.lit(".py")).alias("path"), F.lit(None).cast("int").alias("line")).distinct()
    return rank.ranked_symbols(tasks, symbols).select("task_id", "name", "path", "score", "place")


_PROSE = r"""trim(regexp_replace(array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|\||```)')), lambda x: regexp_replace(x, '^(?:[*+-]|[0-9]+[.)])\s+', '')), ' '), '\s+', ' ', 'g'))"""
_RULE = r"""WITH p AS (SELECT doc_id, %s AS prose FROM documents),
x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(prose, '\*\*(.+?)\*\*', 1), lambda b: regexp_replace(trim(b), ':+$', '')), lambda b: length(b) >= 40 AND contains(b, ' '))[1] AS bold,
regexp_extract(prose, '(?i)(?:^|[.\n])\s*(?:lesson|rule|(?:the )?discipline)\s*:\s*(.+)', 1) AS marked,
list_filter(list_transform(string_split(regexp_replace(prose, '([!.?])\s+(["*0-9A-Z`])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda z: trim(z)), lambda z: length(z) >= 40)[1] AS plain FROM p),
c AS (SELECT doc_id, bold, plain, trim(coalesce(nullif(regexp_extract(marked, '^(.*?[!.?])(?:\s|$)', 1), ''), marked)) AS clause FROM x),
r AS (SELECT doc_id, trim(replace(coalesce(bold, CASE WHEN length(clause) >= 8 THEN clause END, plain), '**', '')) AS rule FROM c)
SELECT doc_id, CASE WHEN length(rule) <= 240 THEN rule ELSE rtrim(regexp_replace(substring(rule, 1, 240), ' [^ ]*$', '')) || '…' END AS rule FROM r""" % _PROSE


@registered(_RULE)
def doc_rule_sentence(spark, sf_dir):
    """The rule sentence of each document."""
    told = t(spark, sf_dir, "documents").select("doc_id", text.prose_of(F.col("text")).alias("prose")).select("doc_id", text.rule_sentence(F.col("prose")).alias("rule"))
    return told.select("doc_id", text.trimmed(F.col("rule")).alias("rule"))


@registered("SELECT page_id, array_to_string(list_slice(list_concat(['src/m' || page_id || '.py:' || (page_id % 9), 'a.go:7'], CASE page_id % 3 WHEN 0 THEN ['lib/x' || page_id] WHEN 1 THEN ['y.toml', 'u/v:3', 'w/x.rs'] ELSE [] END), 1, 5), ' ') AS cites FROM pages")
def page_cites(spark, sf_dir):
    """References among a page's text, which has none of its own: with a line first, then those in back quotes; one that comes twice counts once."""
    quoted = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("`lib/x"), "page_id", F.lit("` `plain`"))).when(F.col("page_id") % 3 == 1, "`y.toml` or `u/v:3`, `w/x.rs`, `z.c`").otherwise("`two words/x`")
    body = F.concat(F.replace("html", F.lit("`"), F.lit("'")), quoted, F.lit(" in src/m"), "page_id", F.lit(".py:"), F.col("page_id") % 9, F.lit(", a.go:7 and a.go:7."))
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(text.cites(body), " ").alias("cites"))


@registered("SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages) GROUP BY target")
def page_imports(spark, sf_dir):
    """Pages' links as imports of modules, a line each."""
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1), lambda x: F.concat(F.lit('import a from "'), x, F.lit('";')))
    files = t(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), F.concat("page_id", F.lit(".ts")).alias("path"), F.array_join(links, "\n").alias("source"))
    found = code.code_facts(files).where("predicate = 'imports'").select(F.col("object_name").alias("target"), F.col("subject_name").alias("page_id"))
    return found.groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@registered("SELECT doc_id AS entity_id, sha256(text) AS src_hash FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0)")
def src_hash_skip(spark, sf_dir):
    """What is to be embedded: texts that the index of this model doesn't hold as they are. Of labelled documents, it holds some as they were, and some of another model."""
    docs = t(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("entity_id"), "text")
    of = docs.join(t(spark, sf_dir, "labels"), F.expr("entity_id = doc_id")).select("entity_id", F.when(F.col("entity_id") % 3 == 0, "other").otherwise("m").alias("model"), F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise("old"), 256).alias("src_hash"))
    return semantic.to_embed(docs, of, "m").select("entity_id", "src_hash")


_NEAR = "WITH v AS (SELECT vec_id AS entity_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), s AS (SELECT q.entity_id AS query_id, v.entity_id, round(list_dot_product(q.vec, v.vec), 4) AS score FROM v q JOIN v ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS place FROM s)"


@registered(f"{_NEAR} SELECT query_id, entity_id, score, place FROM r WHERE place <= 5")
def cosine_topk(spark, sf_dir):
    vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vec"))
    return rank.cosine_top(vectors.select(F.col("entity_id").alias("query_id"), "vec"), vectors)


@registered(f"""{_NEAR}, lex AS (SELECT query_id AS task_id, 'v' || entity_id::VARCHAR AS name, 'p' AS path, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS entity_id FROM embeddings q JOIN embeddings e ON e.vec_id > q.vec_id AND e.vec_id <= q.vec_id + 2)),
sem AS (SELECT query_id AS task_id, 'v' || entity_id::VARCHAR AS name, 'p' AS path, place FROM r WHERE place <= 5),
b AS (SELECT *, 'lexical' AS source FROM lex UNION ALL SELECT *, 'semantic' FROM sem),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY task_id, name, path ORDER BY source, place) = 1),
k AS (SELECT task_id, name, path, source, row_number() OVER (PARTITION BY task_id ORDER BY source, place, name, path) AS place FROM o) SELECT * FROM k WHERE place <= 5""")
def hybrid_merge(spark, sf_dir):
    near = cosine_topk(spark, sf_dir)
    name = lambda c: F.concat(F.lit("v"), F.col(c))
    sem = near.select(F.col("query_id").alias("task_id"), name("entity_id").alias("name"), F.lit("p").alias("path"), "place")
    ids = t(spark, sf_dir, "embeddings").select("vec_id")
    lex = ids.select(F.col("vec_id").alias("task_id"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("vec_id")).join(ids, "vec_id").select("task_id", name("vec_id").alias("name"), F.lit("p").alias("path"), F.row_number().over(Window.partitionBy("task_id").orderBy("vec_id")).alias("place"))
    return rank.hybrid(lex, sem)


@registered("SELECT conv_id, turn, role = 'user' AS is_header, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM conversations")
def gaps_islands_log(spark, sf_dir):
    lines = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.col("role").alias("line"))
    return changes.groups_of_lines(lines, F.col("line") == "user", ("conv_id",)).select("conv_id", F.col("n").alias("turn"), "is_header", "grp")


