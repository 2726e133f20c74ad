"""A task's prompt with what the graph knows about it, or unchanged where it knows nothing."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import terms
from factloom.operators.merge import Graph
from factloom.operators.query import explain_entity, named, query_facts
from factloom.operators.rank import TOP, defined_symbols, hybrid, ranked_symbols, relevant_lessons
from factloom.sources.files import tree_paths

log = logging.getLogger(__name__)
HEAD = "[graph] Places in the code that this is likely about:"
LESSONS_HEAD = "Lessons and conventions that bear on it:"
TAIL = "Begin with the file that fits best."
RELATIONS = ("called-by", "calls", "tests", "tested-by", "raises", "co-changes-with")


def neighbourhoods(symbols: DataFrame, graph: Graph, repo: str | None = None, most: int = 3) -> DataFrame:
    """``(name, path, block)``: a line for each of ``symbols (name, path, line)`` with up to ``most`` names per relation. All symbols are joined at once."""
    facts = named(graph.current(), graph.entities)
    if repo is not None:
        facts = facts.where(F.col("subject_repo") == repo)
    out = facts.where("predicate in ('calls', 'called-by', 'tests', 'raises') and object_name is not null").select(F.col("subject_name").alias("of"), F.col("predicate").alias("relation"), F.col("object_name").alias("other"))
    turned = facts.where("predicate in ('calls', 'tests') and object_name is not null").select(F.col("object_name").alias("of"), F.when(F.col("predicate") == "calls", "called-by").otherwise("tested-by").alias("relation"), F.col("subject_name").alias("other"))
    by_name = symbols.join(out.unionByName(turned), F.col("name") == F.col("of")).select("name", "path", "relation", "other")
    with_file = facts.where("predicate = 'co-changed-with'").select(F.col("subject_name").alias("of"), F.col("object_name").alias("other"))
    by_file = symbols.join(with_file, F.col("path") == F.col("of")).select("name", "path", F.lit("co-changes-with").alias("relation"), "other")
    listed = by_name.unionByName(by_file).groupBy("name", "path", "relation").agg(F.slice(F.array_sort(F.collect_set("other")), 1, most).alias("others"))
    place = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation"))
    told = listed.groupBy("name", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.concat(F.col("relation"), F.lit(" "), F.array_join("others", ", ")).alias("text")))), lambda x: x.text), "; ").alias("told"))
    head = F.concat(F.lit("- `"), F.col("name"), F.lit("` — "), F.col("path"), F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line"))).otherwise(""))
    return symbols.join(told, ["name", "path"], "left").select("name", "path", F.concat(head, F.when(F.col("told").isNotNull(), F.concat(F.lit(" ("), F.col("told"), F.lit(")"))).otherwise("")).alias("block"))


def files_under(spark: SparkSession, folder: str) -> DataFrame:
    """``(path)`` of the files under a folder, for ``assist``'s ``workspace``; none if there is no such folder."""
    return spark.createDataFrame([(p,) for p in tree_paths(folder)], "path string")


def _proposed(spark: SparkSession, proposals) -> DataFrame:
    """Semantic proposals as rows of their own; none if they can't be had, as then the lexical ones must do."""
    schema = "task_id long, name string, path string, place long"
    if proposals is None:
        return spark.createDataFrame([], schema)
    try:
        rows = (proposals() if callable(proposals) else proposals).select("task_id", "name", "path", "place").collect()
    except Exception as error:  # an embedder may fail in any way
        log.warning("no semantic proposals: %s", error)
        rows = []
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def assist(spark: SparkSession, task: str, graph: Graph | None, *, top: int = TOP, repo: str | None = None, workspace: DataFrame | None = None, proposals=None) -> tuple[str, dict]:
    """The prompt and a report ``{injected, grounded_symbols, lexical_hits, semantic_hits}``.

    ``workspace (path)``: files that can be opened; other places are dropped before the prompt is made. ``proposals``: semantic ones (or a function that gives them), which come after
    lexical ones; if they fail, the lexical ones stay. Any other failure leaves the task as it is.
    """
    nothing = {"injected": False, "grounded_symbols": 0, "lexical_hits": 0, "semantic_hits": 0}
    if graph is None:
        return task, nothing
    try:
        tasks = spark.createDataFrame([(0, task)], "task_id long, text string")
        symbols = defined_symbols(graph, repo)
        best = ranked_symbols(tasks, symbols, top)
        lexical = best.select("task_id", "name", "path", "place")
        near = _proposed(spark, proposals)
        if workspace is not None:
            there = workspace.select("path").distinct()
            lexical, near = lexical.join(there, "path", "left_semi"), near.join(there, "path", "left_semi")
        merged = hybrid(lexical, near, top).join(symbols, ["name", "path"], "left")
        rows = merged.orderBy("place").collect()
        if not rows:
            return task, nothing
        few = spark.createDataFrame([(r["name"], r["path"], r["line"]) for r in rows], "name string, path string, line int")
        blocks = {(b["name"], b["path"]): b["block"] for b in neighbourhoods(few, graph, repo).collect()}
        held = named(graph.current().where("predicate in ('lesson', 'because')"), graph.entities).select(F.col("subject_name").alias("topic"), F.col("object_lit").alias("text"))
        lessons = [f"- {r['text']}" for r in relevant_lessons(tasks, held).orderBy(F.col("score").desc(), "text").collect()]
    except PySparkException as error:
        log.warning("the graph can't be asked, the task stays as it is: %s", error)
        return task, nothing
    lines = [HEAD, *(blocks[r["name"], r["path"]] for r in rows), *([LESSONS_HEAD, *lessons] if lessons else []), TAIL]
    kinds = [r["source"] for r in rows]
    return "\n".join(lines) + "\n\n" + task, {"injected": True, "grounded_symbols": len(rows), "lexical_hits": kinds.count("lexical"), "semantic_hits": kinds.count("semantic")}


def grounded_count(prompt: str) -> int:
    """Places that a prompt names, for telling whether assistance fired."""
    return sum(line.startswith("- `") for line in prompt.splitlines())


#: Rows of a tool's answer: by default, and at most.
ROWS, MOST_ROWS = 12, 200
TOOLS = [
    {"name": "graph_query", "description": "Current facts by subject, predicate, object or repository.", "inputSchema": {"type": "object", "properties": {k: {"type": "string"} for k in ("subject", "predicate", "object", "repo")} | {"limit": {"type": "integer"}}}},
    {"name": "graph_explain", "description": "What a named entity does, and what is done to it.", "inputSchema": {"type": "object", "properties": {"name": {"type": "string"}, "repo": {"type": "string"}}, "required": ["name"]}},
]


def shown(row) -> str:
    value = row["object_name"] if row["object_name"] is not None else row["object_lit"]
    sources = f" [{row['sources'][0]}]" if row["sources"] else ""
    return f"{row['subject_name']} {row['predicate']} {value} ({row['confidence']:.2f}){sources}"


class ToolError(ValueError):
    """What a tool was asked can't be answered."""


def run_tool(graph: Graph | None, name: str, arguments: dict) -> str:
    """A tool's answer as text; failures are answers too."""
    try:
        return tool_answer(graph, name, arguments)
    except Exception as error:  # the caller is a model that reads the answer
        log.warning("tool %s failed: %s", name, error)
        return f"memory query failed: {error}"


def tool_answer(graph: Graph | None, name: str, arguments: dict) -> str:
    """A tool's answer as text. A limit that is no positive number is ``ROWS``, a larger one than ``MOST_ROWS`` is that."""
    if graph is None:
        return "memory graph unavailable: there is no store"
    if not isinstance(arguments, dict):
        raise ToolError("arguments are an object")
    try:
        limit = int(arguments.get("limit", ROWS))
    except (TypeError, ValueError, OverflowError):
        limit = ROWS
    limit = min(limit, MOST_ROWS) if limit > 0 else ROWS
    if name == "graph_query":
        rows = query_facts(graph, subject=arguments.get("subject"), predicate=arguments.get("predicate"), obj=arguments.get("object"), repo=arguments.get("repo"), limit=limit).orderBy(F.col("confidence").desc(), F.col("valid_from").desc(), "fact_id").collect()
        return "\n".join(map(shown, rows)) or "no facts match that query"
    if name == "graph_explain":
        entity, out, into = explain_entity(graph, str(arguments.get("name", "")), arguments.get("repo"), limit=10)
        found = entity.first()
        if found is None:
            return "no facts: unknown entity"
        return "\n".join([f"{found['kind']} {found['name']}", *map(shown, out.orderBy("fact_id").collect()), *map(shown, into.orderBy("fact_id").collect())])
    raise ToolError(f"no tool {name}")


def ranked_terms(tasks: DataFrame) -> DataFrame:
    """``(task_id, terms)`` as one string per task."""
    return tasks.select("task_id", F.array_join(terms(F.col("text")), " ").alias("terms"))


