"""``python -m factloom``: build, status, query, explain, assist, semantic-index, tool, serve, watch."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators import semantic
from factloom.operators.assist import assist, files_under, run_tool
from factloom.operators.health import freshness, graph_health, update_plan
from factloom.operators.store import Store, empty
from factloom.plans.pipeline import build
from factloom.plans.rpc import serve
from factloom.sources import changes, files, notes
from factloom.streaming.refresh import only_one

_STATE = "repo string, branch string, head string, ahead long, behind long, dirty long"


def _session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    spark = SparkSession.builder.appName("factloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _name(root: str) -> str:
    return os.path.basename(os.path.abspath(root))


def _built(spark: SparkSession, args) -> int:
    for root in args.repo:
        if not os.path.isdir(root):
            print(f"no such repository: {root}", file=sys.stderr)
            return 1
    store = Store(spark, args.store)
    tree = None
    for root in args.repo:
        own = files.repo_files(spark, root, _name(root))
        tree = own if tree is None else tree.unionByName(own)
    logs = {_name(root): changes.git_log(spark, root) for root in args.repo}
    told = notes.read_notes(spark, *args.notes) if args.notes else None
    graph = build(store.load() or empty(spark), tree, F.current_timestamp(), logs, told, derived=not args.no_derive)
    store.save(graph)
    health = json.loads(graph_health(graph.facts, graph.entities, F.current_timestamp()).toJSON().first())
    print(json.dumps({"facts": graph.current().count(), "entities": graph.entities.count(), "health": health}))
    return 0


def _watched(spark: SparkSession, args) -> int:
    with only_one(f"{args.store}.lock") as mine:
        if not mine:
            print("another pass is running")
            return 0
        states = spark.createDataFrame([changes.repo_state(r) for r in args.repo], _STATE)
        plan = {r.repo: r.action for r in update_plan(states).collect()}
        pulled = [r for r, action in plan.items() if action == "pull" and changes.fast_forward(r)]
        print(json.dumps(plan))
        return _built(spark, args) if pulled or args.force else 0


def _indexed(spark: SparkSession, store: Store, args) -> int:
    graph = store.load()
    if graph is None or not os.path.isdir(args.repo):
        print(f"no graph in {args.store}" if graph is None else f"no such repository: {args.repo}", file=sys.stderr)
        return 1
    texts = semantic.texts_to_index(graph, files.repo_files(spark, args.repo, _name(args.repo)), _name(args.repo))
    held = store.vectors()
    try:
        new = semantic.to_embed(texts, held, args.model).count()
        store.save_vectors(semantic.reindexed(held, texts, semantic.http_embedder(args.endpoint, args.model, args.api_key), args.model))
    except Exception as error:  # to index is what was asked for: its failure is the command's
        print(f"the embedder failed: {error}", file=sys.stderr)
        return 1
    print(json.dumps({"embedded": new, "skipped": texts.count() - new}))
    return 0


def _status(spark: SparkSession, graph, args) -> str:
    if graph is None:
        return "no graph"
    told = json.loads(graph_health(graph.facts, graph.entities, F.current_timestamp()).toJSON().first())
    if args.repos:
        newest = F.lit(graph.current().agg(F.max("created_at")).first()[0])
        states = spark.createDataFrame([changes.repo_state(r) for r in args.repos], _STATE)
        told["freshness"] = json.loads(freshness(states, newest, F.current_timestamp()).toJSON().first())
    return json.dumps(told)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str):
        p = commands.add_parser(name)
        p.add_argument("--store", default="graph")
        for option in options:
            p.add_argument(f"--{option}")
        return p

    for name in ("build", "watch"):
        p = command(name)
        p.add_argument("repo", nargs="+")
        p.add_argument("--notes", nargs="*", default=[])
        p.add_argument("--no-derive", action="store_true")
        if name == "watch":
            p.add_argument("--interval", type=float, default=0.0, help="seconds between passes; 0: one pass")
            p.add_argument("--force", action="store_true")
    command("status").add_argument("--repos", nargs="*", default=[])
    command("query", "subject", "predicate", "object", "repo").add_argument("--limit", default=25)
    command("explain", "repo").add_argument("name")
    p = command("semantic-index")
    p.add_argument("repo")
    p.add_argument("--endpoint", required=True)
    p.add_argument("--model", default="embed")
    p.add_argument("--api-key", default="none")
    asked = command("assist", "repo", "workspace", "endpoint")
    asked.add_argument("task")
    for p in (asked, command("serve", "endpoint")):
        p.add_argument("--model", default="embed")
    p = command("tool")
    p.add_argument("name")
    p.add_argument("arguments", nargs="?", default="{}")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if args.command == "tool":
        try:
            args.arguments = json.loads(args.arguments)
        except ValueError as error:
            print(f"arguments aren't JSON: {error}", file=sys.stderr)
            return 2
    spark = _session()
    if args.command == "build":
        return _built(spark, args)
    if args.command == "watch":
        while True:
            if code := _watched(spark, args):
                return code
            if not args.interval:
                return 0
            time.sleep(args.interval)
    store = Store(spark, args.store)
    if args.command == "semantic-index":
        return _indexed(spark, store, args)
    graph = store.load()

    def proposer(task: str, repo: str | None = None):
        tasks = spark.createDataFrame([(0, task)], "task_id long, text string")
        return semantic.proposed(tasks, store.vectors(), graph, semantic.http_embedder(args.endpoint, args.model), args.model, repo=repo)

    if args.command == "status":
        print(_status(spark, graph, args))
    elif args.command == "query":
        print(run_tool(graph, "graph_query", {k: v for k in ("subject", "predicate", "object", "repo", "limit") if (v := getattr(args, k)) is not None}))
    elif args.command == "explain":
        print(run_tool(graph, "graph_explain", {"name": args.name, "repo": args.repo}))
    elif args.command == "assist":
        there = files_under(spark, args.workspace) if args.workspace else None
        prompt, report = assist(spark, args.task, graph, repo=args.repo, workspace=there, proposals=(lambda: proposer(args.task, args.repo)) if args.endpoint else None)
        print(prompt)
        print(" ".join(f"{k}={v}" for k, v in report.items()), file=sys.stderr)
    elif args.command == "tool":
        print(run_tool(graph, args.name, args.arguments))
    else:
        serve(spark, graph, proposer=proposer if args.endpoint else None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
