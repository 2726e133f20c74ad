"""Registered queries of extraction, merging and asking, on sources and graphs that are made row by row from the relational tables, so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import assist, derive, health, merge, query, rank, semantic
from factloom.plans import pipeline
from factloom.plans.queries import NOW, registered, t, terms_sql, versions
from factloom.schemas import CANDIDATES, FACTS
from factloom.sources import code, notes


def filled(template: str) -> Column:
    """``template`` with ``{k}`` and ``{n}`` from the columns of these names."""
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col("k").cast("string")), F.lit("{n}"), F.col("n").cast("string"))


def _sql(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{k}", "' || k || '").replace("{n}", "' || n || '") + "'"


def suppliers(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))


_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)"


def _rows(columns: str, where: str, *rows: tuple) -> str:
    """A union of templates for the rows of ``s`` that pass."""
    names = columns.split(", ")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(v) if isinstance(v, str) else v} AS {c}" for c, v in zip(names, row[:-1] if len(row) > len(names) else row, strict=True)) + f" FROM s WHERE {where}" + (f" AND {row[-1]}" if len(row) > len(names) else "") for row in rows)


# extraction

_PYTHON = """import os.path
from lib.m{n} import helper as h

class C{k}(Base{n}, abc.ABC):
    @property
    def title(self):
        return self.inner.fmt({k})

def f{k}(x=os.getcwd()):
    if x:
        raise errors.E{n}(x)
    def deep():
        return g(x)
    return h(deep)
"""
_PY_PATH = "CASE WHEN k % 5 = 0 THEN 'pkg' || n || '/p' || k || '/__init__.py' ELSE 'pkg' || n || '/mod' || k || '.py' END"
_PY_MODULE = "CASE WHEN k % 5 = 0 THEN 'pkg' || n || '.p' || k ELSE 'pkg' || n || '.mod' || k END"


def _python_sql() -> str:
    out = []
    for kind, name, predicate, target, line in (
        ("file", None, "imports", "os", 1), ("module", None, "depends-on", "os", 1), ("file", None, "imports", "lib", 2), ("module", None, "depends-on", "lib", 2),
        ("symbol", "C{k}", "defined-in", None, 4), ("symbol", "C{k}", "inherits", "Base{n}", 4), ("symbol", "C{k}", "inherits", "abc.ABC", 4),
        ("symbol", "C{k}.title", "defined-in", None, 6), ("symbol", "C{k}.title", "decorated-by", "property", 5), ("symbol", "C{k}.title", "calls", "self.inner.fmt", 7),
        ("symbol", "f{k}", "defined-in", None, 9), ("symbol", "f{k}", "calls", "os.getcwd", 9), ("symbol", "f{k}", "calls", "errors.E{n}", 11), ("symbol", "f{k}", "raises", "errors.E{n}", 11),
        ("symbol", "f{k}", "calls", "h", 14), ("symbol", "f{k}.deep", "defined-in", None, 12), ("symbol", "f{k}.deep", "calls", "g", 13),
    ):
        subject = _sql(name) if name else {"file": _PY_PATH, "module": _PY_MODULE}[kind]
        out.append(f"SELECT '{kind}' AS subject_kind, {subject} AS subject_name, '{predicate}' AS predicate, {_sql(target) if target else _PY_PATH} AS object_name, 'code:' || {_PY_PATH} || ':{line}' AS origin FROM s WHERE k % 7 <> 0")
    return f"WITH {_S} " + " UNION ALL ".join(out)


@registered(_python_sql())
def extract_python(spark, sf_dir):
    """A module for each supplier; every seventh one has a syntax error and gives nothing."""
    path = F.when(F.col("k") % 5 == 0, filled("pkg{n}/p{k}/__init__.py")).otherwise(filled("pkg{n}/mod{k}.py"))
    source = F.when(F.col("k") % 7 == 0, F.concat(filled(_PYTHON), F.lit("def broken(:\n"))).otherwise(filled(_PYTHON))
    files = suppliers(spark, sf_dir).select(F.lit("r").alias("repo"), path.alias("path"), source.alias("source"))
    return code.code_facts(files).select("subject_kind", "subject_name", "predicate", "object_name", "origin")


_LINES = 'import Lib{n}\nimport { a } from "./m{n}"\n#include <sys/h{n}.h>\n  export default class V{k} {\npublic static func run{k}() {\nlet x = 1\n'
_LINE_PATH = "CASE k % 3 WHEN 0 THEN 'ui/v' || k || '.swift' WHEN 1 THEN 'ui/v' || k || '.ts' ELSE 'ui/v' || k || '.c' END"


def _lines_sql() -> str:
    out = []
    for line, name in ((1, "Lib{n}"), (2, "./m{n}"), (3, "h{n}")):
        out.append(f"SELECT {_LINE_PATH} AS subject_name, 'imports' AS predicate, {_sql(name)} AS object_name, 'code:' || {_LINE_PATH} || ':{line}' AS origin FROM s")
        out.append(f"SELECT 'ui.v' || k, 'depends-on', {_sql(name)}, 'code:' || {_LINE_PATH} || ':{line}' FROM s")
    for line, name in ((4, "V{k}"), (5, "run{k}")):
        out.append(f"SELECT {_sql(name)}, 'defined-in', {_LINE_PATH}, 'code:' || {_LINE_PATH} || ':{line}' FROM s")
    return f"WITH {_S} " + " UNION ALL ".join(out)


@registered(_lines_sql())
def extract_lines(spark, sf_dir):
    path = F.concat(filled("ui/v{k}"), F.when(F.col("k") % 3 == 0, ".swift").when(F.col("k") % 3 == 1, ".ts").otherwise(".c"))
    files = suppliers(spark, sf_dir).select(F.lit("r").alias("repo"), path.alias("path"), filled(_LINES).alias("source"))
    return code.code_facts(files).select("subject_name", "predicate", "object_name", "origin")


_TEST = """import pytest
import requests
from app.old import score
from app.m{n} import score, unused
from . import near
from ..core import deep as d

def test_a{k}():
    assert score(d)
    pytest.fail(requests.get(1))
class TestIt:
    def test_b(self):
        near.x = score
def helper():
    score()
def test_c():
""" + "    d()\n" * 10


@registered(f"""WITH {_S}, x AS ({_rows("subject_name, object_name, line, excerpt", "k % 4 <> 0", ("test_a{k}", "app.m{n}.score", 8, "imported in line 4, read in 9"), ("test_a{k}", "core.deep", 8, "imported in line 6, read in 9"), ("test_a{k}", "requests", 8, "imported in line 2, read in 10", "k % 2 = 0"), ("TestIt.test_b", "app.m{n}.score", 12, "imported in line 4, read in 13"), ("TestIt.test_b", "tests.near", 12, "imported in line 5, read in 13"), ("test_c", "core.deep", 16, "imported in line 6, read in 17, 18, 19, 20, 21, 22, 23, 24…")).replace("FROM s WHERE", ", k FROM s WHERE")})
SELECT subject_name, object_name, 'code:tests/test_' || k || '.py:' || line AS origin, excerpt FROM x""")
def extract_tests(spark, sf_dir):
    """Files of tests, of which every fourth lies where none are; ``requests`` is first-party in one of the two repos."""
    s = suppliers(spark, sf_dir)
    path = F.when(F.col("k") % 4 == 0, filled("pkg/mod{k}.py")).otherwise(filled("tests/test_{k}.py"))
    files = s.select(F.concat(F.lit("r"), F.col("k") % 2).alias("repo"), path.alias("path"), filled(_TEST).alias("source"))
    own = spark.createDataFrame([("r0", "requests"), ("r1", "app")], "repo string, package string")
    return code.tested_facts(files, own).select("subject_name", "object_name", "origin", "excerpt")


_NOTE = """What stands before the first heading is dropped.
# Lesson — 2024-01-02: 3.1 Topic {k} (aside)

- **Always keep the value of {k} below the limit of nation {n}.** It matters. Why: the meter of {n} wraps around. See src/m{n}.py:{k} and `lib/x{k}`.

Overview
========
This body is long enough to be a lesson, but its title is skipped.
Short {k}
---------
too short
"""


@registered(f"WITH {_S} " + _rows("path, subject_name, predicate, object_lit", "true", ("doc:n{k}.md", "Topic {k}", "lesson", "Always keep the value of {k} below the limit of nation {n}."), ("doc:n{k}.md", "Topic {k}", "because", "the meter of {n} wraps around."), ("doc:n{k}.md", "Topic {k}", "cites", "src/m{n}.py:{k}"), ("doc:n{k}.md", "Topic {k}", "cites", "lib/x{k}")))
def note_lessons(spark, sf_dir):
    told = suppliers(spark, sf_dir).select(filled("n{k}.md").alias("path"), filled(_NOTE).alias("text"))
    return notes.lesson_facts(notes.note_sections(told)).select(F.col("origin").alias("path"), "subject_name", "predicate", "object_lit")


# merging into a graph that holds something


def _customers(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))


def _worth(k: Column) -> Column:
    return F.round(F.lit(0.3) + (k % 5).cast("double") / 10, 4)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _entities(rows: DataFrame) -> DataFrame:
    """Symbols of ``rows (k, name)``, with ``path`` if there is one."""
    path = F.col("path") if "path" in rows.columns else _null()
    then = F.lit("2024-01-01").cast("timestamp")
    return rows.select(F.col("k").cast("long").alias("entity_id"), F.lit("symbol").alias("kind"), "name", _null().alias("repo"), path.alias("path"), _null().alias("meta"), then.alias("first_seen"), then.alias("last_seen"))


def _facts(rows: DataFrame, **columns: Column) -> DataFrame:
    """Facts of ``rows`` in the schema, current ones by default."""
    then = F.lit("2024-01-01").cast("timestamp")
    given = {"object_id": _null("long"), "object_lit": _null(), "confidence": F.lit(1.0), "extractor": F.lit("det:ast@1"), "created_at": then, "valid_from": then, "valid_to": _null("timestamp"), "superseded_by": _null("long")} | columns
    return rows.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in FACTS.fields))


def held_and_offered(spark, sf_dir) -> tuple[merge.Graph, DataFrame]:
    c, k = _customers(spark, sf_dir), F.col("k")
    predicate = F.when(k % 2 == 0, "supersedes").otherwise("prefers")
    facts = _facts(c, fact_id=k, subject_id=k, predicate=predicate, object_lit=F.lit("v0"), confidence=_worth(k), extractor=F.when(k % 3 == 0, "det:a@1").otherwise("llm:x@1"))
    evidence = c.select(k.alias("prov_id"), k.alias("fact_id"), F.lit("doc").alias("source_kind"), F.lit("doc:old").alias("source_ref"), _null().alias("excerpt"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    origin = F.when(k % 5 == 0, "doc:new").when(k % 5 == 1, "git:r").when(k % 5 == 2, "code:a.py:1").otherwise("derived")
    given = {"seq": k, "subject_kind": F.lit("symbol"), "subject_name": F.col("name"), "predicate": predicate, "object_lit": F.when(k % 4 < 2, "v0").otherwise("v1"), "confidence": _worth(k + 2), "extractor": F.lit("llm:y@1"), "origin": origin, "excerpt": F.lit("e")}
    offers = c.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATES.fields))
    return merge.Graph(_entities(c), facts, evidence), offers


_MERGED = """c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'supersedes' ELSE 'prefers' END AS predicate, round(0.3::DOUBLE + (c_custkey % 5)::DOUBLE / 10, 4) AS held, round(0.3::DOUBLE + ((c_custkey + 2) % 5)::DOUBLE / 10, 4) AS offered, c_custkey % 3 = 0 AS det, CASE WHEN c_custkey % 4 < 2 THEN 'v0' ELSE 'v1' END AS v FROM customer),
d AS (SELECT *, v = 'v0' AS again, CASE WHEN v = 'v0' THEN false WHEN k % 2 = 1 THEN true ELSE NOT det AND offered >= held END AS added FROM c),
f AS (SELECT k, predicate, 'v0' AS object_lit, CASE WHEN again AND NOT det THEN round(least(0.99::DOUBLE, greatest(held, offered) + (1.0::DOUBLE - greatest(held, offered)) * 0.3::DOUBLE), 4) ELSE held END AS confidence, CASE WHEN det THEN 'det:a@1' ELSE 'llm:x@1' END AS extractor, NOT (added AND k % 2 = 0) AS live FROM d
UNION ALL SELECT k, predicate, 'v1', offered, 'llm:y@1', true FROM d WHERE added)"""


@registered(f"WITH {_MERGED} SELECT k AS subject_id, predicate, object_lit, confidence, extractor, live FROM f")
def consolidated_graph(spark, sf_dir):
    """Candidates against a graph that holds a value for each subject: corroborated, added beside, superseded, dropped as weaker, or barred by a deterministic fact."""
    after = merge.consolidated(*held_and_offered(spark, sf_dir), F.to_timestamp(F.lit(NOW)))
    return after.facts.select("subject_id", "predicate", "object_lit", "confidence", "extractor", F.col("valid_to").isNull().alias("live"))


@registered(f"""WITH {_MERGED} SELECT k AS subject_id, 'v0' AS object_lit, 'doc' AS source_kind, 'doc:old' AS source_ref FROM d
UNION ALL SELECT k, v, CASE k % 5 WHEN 0 THEN 'doc' WHEN 1 THEN 'commit' WHEN 2 THEN 'code_line' ELSE 'derived' END, CASE k % 5 WHEN 0 THEN 'doc:new' WHEN 1 THEN 'git:r' WHEN 2 THEN 'code:a.py:1' ELSE 'derived' END FROM d WHERE again OR added""")
def provenance_added(spark, sf_dir):
    """Evidence after the same merge: of each candidate whose fact is in the graph, beside what was there."""
    after = merge.consolidated(*held_and_offered(spark, sf_dir), F.to_timestamp(F.lit(NOW)))
    return after.provenance.join(after.facts, "fact_id").select("subject_id", "object_lit", "source_kind", "source_ref")


@registered("""WITH e AS (SELECT a.c_custkey AS k, b.c_custkey AS o FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
SELECT k AS subject_id, o AS object_id, k % 3 = 0 AS live, k % 2 = 0 AS old FROM e WHERE k % 2 = 0 OR k % 3 = 0""")
def rederived_facts(spark, sf_dir):
    """Derived facts after another derivation: vanished ones are closed, those that still follow stay as they were, new ones come."""
    c, k = _customers(spark, sf_dir), F.col("k")
    after = c.select((k - 1).alias("k"), F.col("name").alias("dst"))
    pairs = c.join(after, "k")
    held = _facts(pairs.where("k % 2 = 0"), fact_id=k, subject_id=k, predicate=F.lit("called-by"), object_id=k + 1, confidence=F.lit(0.98), extractor=F.lit("der:inverse@1"))
    none = spark.createDataFrame([], "prov_id long, fact_id long, source_kind string, source_ref string, excerpt string, created_at timestamp")
    derived = pairs.where("k % 3 = 0").select(F.col("name").alias("src"), "dst", F.lit("called-by").alias("predicate"), _null().alias("repo"), F.lit(0.98).alias("confidence"), F.lit("x").alias("excerpt"), F.lit("der:inverse@1").alias("extractor"), F.lit("symbol").alias("kind"))
    graph = pipeline.rederived(merge.Graph(_entities(c), held, none), derived, F.to_timestamp(F.lit(NOW)), ("der:inverse@1",))
    return graph.facts.select("subject_id", "object_id", F.col("valid_to").isNull().alias("live"), (F.col("created_at") < F.to_timestamp(F.lit(NOW))).alias("old"))


# derivation


def call_chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chains of four suppliers: each calls the next one and inherits from it, the last one raises its nation's exception."""
    s, k = suppliers(spark, sf_dir), F.col("k")
    symbols = s.select(k, filled("s{k}").alias("name"), filled("p{k}.py").alias("path"))
    raised = s.select("n").distinct().select((F.lit(1 << 40) + F.col("n")).alias("k"), F.concat(F.lit("E"), "n").alias("name"), _null().alias("path"))
    next_ = s.where("k % 4 < 3").join(s.select((k - 1).alias("k")), "k", "left_semi")
    edges = [_facts(next_, fact_id=k * 3 + i, subject_id=k, object_id=k + 1, predicate=F.lit(p)) for i, p in enumerate(("calls", "inherits"))]
    edges.append(_facts(s.where("k % 4 = 3"), fact_id=k * 3 + 2, subject_id=k, object_id=F.lit(1 << 40) + F.col("n"), predicate=F.lit("raises")))
    closed = _facts(next_, fact_id=-k, subject_id=k + 1, object_id=k, predicate=F.lit("calls"), valid_to=F.to_timestamp(F.lit(NOW)))
    facts = edges[0].unionAll(edges[1]).unionAll(edges[2]).unionAll(closed)
    return facts, _entities(symbols.unionAll(raised))


_CHAINS = f"{_S}, e AS (SELECT a.k, a.n FROM s a JOIN s b ON b.k = a.k + 1 WHERE a.k % 4 < 3)"


@registered(f"""WITH {_CHAINS}, j AS (SELECT a.k, g.d, b.n FROM s a JOIN (VALUES (1), (2), (3)) g(d) ON a.k % 4 + g.d < 4 JOIN s b ON b.k = a.k + g.d)
SELECT 'called-by' AS predicate, 's' || (k + 1) AS src, 's' || k AS dst, 0.98::DOUBLE AS confidence FROM e
UNION ALL SELECT 'raised-by', 'E' || n, 's' || k, 0.98::DOUBLE FROM s WHERE k % 4 = 3
UNION ALL SELECT 'isa', 's' || k, 's' || (k + d), round(0.95::DOUBLE * pow(0.9::DOUBLE, d - 2), 4) FROM j WHERE d > 1
UNION ALL SELECT 'depends-on', 'p' || k || '.py', 'p' || (k + 1) || '.py', 0.9::DOUBLE FROM e
UNION ALL SELECT 'reaches', 's' || k, 's' || (k + d), 0.81::DOUBLE FROM j WHERE d = 2
UNION ALL SELECT 'may-raise', 's' || k, 'E' || n, round(pow(0.9::DOUBLE, d), 4) FROM j WHERE k % 4 + d = 3""")
def derive_all(spark, sf_dir):
    return derive.all_derived(*call_chains(spark, sf_dir)).select("predicate", "src", "dst", "confidence")


@registered(f"""WITH {_CHAINS} SELECT p AS predicate, 's' || k AS src, 's' || (k + 1) AS dst, 'p' || k || '.py' AS src_path, 'p' || (k + 1) || '.py' AS dst_path FROM e, (VALUES ('calls'), ('inherits')) v(p)
UNION ALL SELECT 'raises', 's' || k, 'E' || n, 'p' || k || '.py', '' FROM s WHERE k % 4 = 3""")
def live_edges(spark, sf_dir):
    return derive.live_edges(*call_chains(spark, sf_dir)).select("predicate", "src", "dst", "src_path", "dst_path")


@registered(f"WITH {_CHAINS} SELECT 'm' || k AS src, 'm' || (k + 2) AS dst, 0.81::DOUBLE AS confidence FROM s WHERE k % 4 < 2 AND k IN (SELECT k FROM e) AND k + 1 IN (SELECT k FROM e) UNION ALL SELECT 'm' || k, 'm' || (k + 3), 0.729::DOUBLE FROM s WHERE k % 4 = 0 AND k IN (SELECT k FROM e) AND k + 1 IN (SELECT k FROM e) AND k + 2 IN (SELECT k FROM e)")
def derive_second_round(spark, sf_dir):
    """Dependencies between modules over several steps; those of symbols don't count."""
    facts, _ = call_chains(spark, sf_dir)
    s = suppliers(spark, sf_dir)
    modules = _entities(s.select("k", filled("m{k}").alias("name"))).withColumn("kind", F.lit("module"))
    depends = facts.where("predicate = 'calls'").withColumn("predicate", F.lit("depends-on"))
    other = facts.where("predicate = 'inherits'").withColumn("object_id", F.lit(-1).cast("long"))
    return derive.second_round(depends.unionAll(other), modules).select("src", "dst", "confidence")


# asking


def _called(spark, sf_dir) -> merge.Graph:
    """Each supplier calls the next five; files change with the next one's; lines of definition come from evidence."""
    s, k = suppliers(spark, sf_dir), F.col("k")
    there = s.select(F.col("k").alias("o"))
    symbols = _entities(s.select("k", filled("s{k}").alias("name"), filled("p{k}.py").alias("path")))
    files = _entities(s.select((k + (1 << 40)).alias("k"), filled("p{k}.py").alias("name"))).withColumn("kind", F.lit("file"))
    calls = s.withColumn("o", F.explode(F.sequence(k + 1, k + 5))).join(there, "o", "left_semi")
    calls = _facts(calls, fact_id=k * 100 + F.col("o") - k, subject_id=k, object_id=F.col("o"), predicate=F.lit("calls"))
    beside = s.withColumn("o", k + 1).join(there, "o", "left_semi")
    beside = _facts(beside, fact_id=k * 100 + 50, subject_id=k + (1 << 40), object_id=F.col("o") + (1 << 40), predicate=F.lit("co-changed-with"))
    defined = _facts(s, fact_id=k * 100 + 60, subject_id=k, object_id=k + (1 << 40), predicate=F.lit("defined-in"))
    lines = s.withColumn("line", F.explode(F.array(k % 9 + 5, k % 7 + 3, F.lit(None))))
    evidence = lines.select(k.alias("prov_id"), (k * 100 + 60).alias("fact_id"), F.lit("code_line").alias("source_kind"), F.concat(filled("code:p{k}.py:"), F.coalesce(F.col("line").cast("string"), F.lit("x"))).alias("source_ref"))
    return merge.Graph(symbols.unionAll(files), calls.unionAll(beside).unionAll(defined), evidence)


@registered(f"WITH {_S} SELECT 's' || k AS name, 'p' || k || '.py' AS path, least(k % 9 + 5, k % 7 + 3)::INTEGER AS line FROM s")
def defined_lines(spark, sf_dir):
    return rank.defined_symbols(_called(spark, sf_dir))


@registered(f"""WITH {_S}, o AS (SELECT a.k, list_sort(list('s' || b.k) FILTER (WHERE b.k < a.k))[1:3] AS callers, list_sort(list('s' || b.k) FILTER (WHERE b.k > a.k))[1:3] AS callees FROM s a JOIN s b ON b.k BETWEEN a.k - 5 AND a.k + 5 AND a.k <> b.k GROUP BY a.k),
x AS (SELECT s.k, list_filter(['called-by ' || nullif(array_to_string(callers, ', '), ''), 'calls ' || nullif(array_to_string(callees, ', '), ''), CASE WHEN s.k + 1 IN (SELECT k FROM s) THEN 'co-changes-with p' || (s.k + 1) || '.py' END], lambda z: z IS NOT NULL) AS told FROM s LEFT JOIN o ON s.k = o.k)
SELECT 's' || k AS name, '- `s' || k || '` — p' || k || '.py:' || least(k % 9 + 5, k % 7 + 3) || CASE WHEN len(told) > 0 THEN ' (' || array_to_string(told, '; ') || ')' ELSE '' END AS block FROM x""")
def symbol_blocks(spark, sf_dir):
    """The line of each symbol in a prompt, with three names of each relation at most."""
    graph = _called(spark, sf_dir)
    return assist.neighbourhoods(rank.defined_symbols(graph), graph).select("name", "block")


_ASKED = "'the colour of ' || r_name || ' supplier balance'"


@registered(f"""WITH q AS (SELECT r_regionkey AS task_id, list_distinct({terms_sql(_ASKED)}) AS ts FROM region),
l AS (SELECT lower(n_name) AS topic, 'Keep the Color of ' || r_name || ' in ' || n_name || '.' AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT task_id, text, list_sum(list_transform(ts, lambda w: (CASE WHEN contains(topic, w) THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END)))::INTEGER AS score FROM q, l)
SELECT task_id, text, score FROM x WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, text) <= 2""")
def lesson_relevance(spark, sf_dir):
    region = t(spark, sf_dir, "region")
    tasks = region.select(F.col("r_regionkey").alias("task_id"), F.concat(F.lit("the colour of "), "r_name", F.lit(" supplier balance")).alias("text"))
    lessons = t(spark, sf_dir, "nation").join(region, F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("topic"), F.concat(F.lit("Keep the Color of "), "r_name", F.lit(" in "), "n_name", F.lit(".")).alias("text"))
    return rank.relevant_lessons(tasks, lessons)


@registered(f"WITH r AS (SELECT user_id::VARCHAR AS repo, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) % 4 END AS behind FROM events GROUP BY user_id) SELECT max(behind) AS behind, string_agg(CASE WHEN behind > 0 THEN repo || ' is ' || behind || ' commits behind' END, '; ' ORDER BY repo || ' is ' || behind || ' commits behind') AS warnings, round(date_diff('second', (SELECT max(ts) FROM events), TIMESTAMP '{NOW}')::DOUBLE / 86400, 2) AS age_days FROM r")
def freshness_rollup(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    repos = e.groupBy("user_id").agg(F.count("*").alias("n")).select(F.col("user_id").cast("string").alias("repo"), F.when(F.col("n") % 5 != 0, F.col("n") % 4).alias("behind"))
    newest = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    told = health.freshness(repos, newest, F.to_timestamp(F.lit(NOW)).cast("timestamp_ntz"))
    return told.withColumn("warnings", F.array_join("warnings", "; "))


@registered("WITH f AS (SELECT event_id, ts FROM events WHERE event_id % 10 <> 0), n AS (SELECT (SELECT count(*) FROM f WHERE event_id % 3 = 2) AS inferred, (SELECT count(*) FROM f) AS live) SELECT (SELECT min(ts) FROM f) AS oldest, (SELECT max(ts) FROM f) AS newest, array_to_string(list_filter([CASE WHEN inferred > 0.4 * live THEN 'many facts are inferred' END, CASE WHEN (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM events WHERE event_id % 10 <> 0 GROUP BY user_id, event_type, floor(value)::BIGINT % 4)) > 0.05 * live THEN 'many facts are there twice' END, 'facts without a named subject', 'single values contradict each other', 'many inferred facts are dormant'], lambda x: x IS NOT NULL), '; ') AS warnings FROM n")
def health_warnings(spark, sf_dir):
    """The dashboard's ages and warnings; half of the customers have no name here."""
    named = t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    told = health.graph_health(versions(spark, sf_dir), named, F.to_timestamp(F.lit(NOW)).cast("timestamp_ntz"))
    return told.select("oldest", "newest", F.array_join("warnings", "; ").alias("warnings"))


@registered("""WITH x AS (SELECT doc_id, 'f' || doc_id AS name, 'd' || doc_id || '.py' AS path, doc_id % 7 + 1 AS line, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT name, md5(name || ' — ' || path || chr(10) || array_to_string(ls[greatest(1, line - 3):least(len(ls), line + 27)], chr(10))) AS digest FROM x""")
def source_windows(spark, sf_dir):
    """The lines around a definition that are embedded with its name."""
    docs = t(spark, sf_dir, "documents").where("text is not null")
    name, path = F.concat(F.lit("f"), "doc_id"), F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    symbols = docs.select(name.alias("name"), path.alias("path"), (F.col("doc_id") % 7 + 1).cast("int").alias("line"))
    return semantic.window_text(docs.select(path.alias("path"), F.col("text").alias("source")), symbols).select("name", F.md5("text").alias("digest"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(x)), 1.0] for x in texts]


@registered("""WITH l AS (SELECT user_id AS entity_id, event_id AS seq, event_type || ' ' || props AS text FROM events), w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1)
SELECT entity_id, 'm' AS model, 2 AS dim, sha256(text) AS src_hash FROM w""")
def reindexed_vectors(spark, sf_dir):
    """An index after users' newest texts were embedded, half of which it held already."""
    e = t(spark, sf_dir, "events")
    texts = e.select(F.col("user_id").alias("entity_id"), F.concat_ws(" ", "event_type", "props").alias("text"), F.col("event_id").alias("seq"))
    newest = texts.groupBy("entity_id").agg(F.max_by("text", "seq").alias("text"))
    hash_ = F.when(F.col("entity_id") % 2 == 0, F.sha2("text", 256)).otherwise("old")
    index = newest.select("entity_id", F.lit("m").alias("model"), F.lit(2).alias("dim"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec"), hash_.alias("src_hash"))
    return semantic.reindexed(index, texts, _lengths, "m").select("entity_id", "model", "dim", "src_hash")


@registered("SELECT c_custkey AS fact_id, c_name AS subject_name, 'v' AS object_lit, 'doc:' || (c_custkey % 3) AS sources FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def facts_with_sources(spark, sf_dir):
    """Facts of one predicate with their evidence, joined for the rows that are left only."""
    c, k = _customers(spark, sf_dir).join(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), "k"), F.col("k")
    facts = _facts(c, fact_id=k, subject_id=k, predicate=F.col("c_mktsegment"), object_lit=F.lit("v"))
    evidence = c.select(k.alias("prov_id"), k.alias("fact_id"), F.lit("doc").alias("source_kind"), F.concat(F.lit("doc:"), k % 3).alias("source_ref"))
    least = t(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).first()[0]
    rows = query.query_facts(merge.Graph(_entities(c), facts, evidence), predicate=least, limit=None)
    return rows.select("fact_id", "subject_name", "object_lit", F.array_join("sources", ",").alias("sources"))
