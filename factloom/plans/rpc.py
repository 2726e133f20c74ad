"""The graph's tools over JSON lines (JSON-RPC 2.0) on standard input and output."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Callable

from factloom.operators.assist import TOOLS, ToolError, assist, files_under, tool_answer

log = logging.getLogger(__name__)
PROTOCOL = "2024-11-05"
_ASSIST = {"name": "graph_assist", "description": "A task's text with what the graph knows about it.", "inputSchema": {"type": "object", "required": ["task"], "properties": {name: {"type": "string"} for name in ("task", "repo", "workspace")}}}


def call_tool(spark, graph, name: str, arguments: dict, proposer: Callable | None = None) -> dict:
    """A tool's result. Whatever goes wrong is told in the result, with ``isError``; nothing is raised."""
    try:
        if not isinstance(arguments, dict):
            raise ToolError("arguments are an object")
        if name == _ASSIST["name"]:
            task, repo, folder = str(arguments.get("task", "")), arguments.get("repo"), arguments.get("workspace")
            there = files_under(spark, folder) if folder else None
            text = assist(spark, task, graph, repo=repo, workspace=there, proposals=proposer and (lambda: proposer(task, repo)))[0]
        else:
            text = tool_answer(graph, name, arguments)
        failed = False
    except Exception as error:  # a server outlives any one question
        log.warning("tool %s failed: %s", name, error)
        text, failed = f"tool failed: {error}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


class Server:
    """Replies to requests by method name."""

    def __init__(self, spark, graph, proposer: Callable | None = None):
        self.spark, self.graph, self.proposer = spark, graph, proposer
        self.methods = {"tools/call": self.call, "tools/list": lambda _: {"tools": [*TOOLS, _ASSIST]}, "initialize": self.greet, "ping": lambda _: {}}

    def greet(self, params: dict) -> dict:
        return {"serverInfo": {"name": "factloom", "version": "0.1.0"}, "capabilities": {"tools": {}}, "protocolVersion": params.get("protocolVersion", PROTOCOL)}

    def call(self, params: dict) -> dict:
        return call_tool(self.spark, self.graph, str(params.get("name", "")), params.get("arguments") or {}, self.proposer)

    def reply(self, request) -> dict | None:
        """The reply to a request, None to a notification."""
        if not isinstance(request, dict):
            return _failed(None, -32600, "a request is an object")
        number = request.get("id")
        if number is None:
            return None
        method, params = request.get("method"), request.get("params") or {}
        run = self.methods.get(method) if isinstance(method, str) else None
        if run is None:
            return _failed(number, -32601, f"no method {method}")
        if not isinstance(params, dict):
            return _failed(number, -32602, "params are an object")
        return {"jsonrpc": "2.0", "id": number, "result": run(params)}


def _failed(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def handle(spark, graph, request, proposer: Callable | None = None) -> dict | None:
    return Server(spark, graph, proposer).reply(request)


def serve(spark, graph, lines=None, out=None, proposer: Callable | None = None) -> None:
    """Answers line after line until there are no more; a line that isn't JSON gets an error."""
    out, server = out or sys.stdout, Server(spark, graph, proposer)
    for line in sys.stdin if lines is None else lines:
        if not line.strip():
            continue
        try:
            reply = server.reply(json.loads(line))
        except (ValueError, RecursionError):
            reply = _failed(None, -32700, "not JSON")
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)
