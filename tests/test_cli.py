"""The commands on trees on disk, one after the other."""

import io
import json
import logging
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

import factloom
from factloom.__main__ import main
from factloom.operators import derive
from factloom.plans import rpc
from factloom.sources import files


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "proj"
    for path, text in {
        "pkg/__init__.py": "",
        "pkg/core.py": "def parse(text):\n    return text.split()\n\n\ndef run(text):\n    return parse(text)\n",
        "pkg/_x.py": "def hidden():\n    pass\n",
        "pkg/.dot.py": "",
        "tests/test_core.py": "from pkg.core import parse\n\n\ndef test_parse():\n    assert parse('a')\n",
        "docs/notes.md": "# Parsing rules\n\n**Always split on white space before anything is parsed; the core owns it.** Why: callers pass raw text.\n",
        "inner/clone/.git/HEAD": "x",
        "inner/clone/a.py": "def twice(): pass\n",
        "sub/.git": "gitdir: ../.git/modules/sub",
        "sub/b.py": "def twice(): pass\n",
        "node_modules/m.js": "function m() {}",
        "data/bad.py": None,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"x = '\xff'\n" if text is None else text.encode())
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "pkg", "tests")
    git("commit", "-qm", "x")
    return root


def test_all_files_but_other_checkouts_are_seen(spark, root):
    rows = {r.path: r.source for r in files.repo_files(spark, str(root), "proj").collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/core.py", "pkg/_x.py", "pkg/.dot.py", "tests/test_core.py", "data/bad.py"}
    assert rows["data/bad.py"] == "x = '�'\n" and rows["pkg/__init__.py"] == ""
    everything = files.repo_files(spark, f"file://{root}", "proj", only_code=False)
    assert "docs/notes.md" in {r.path for r in everything.collect()} and [r.package for r in files.packages(everything).collect()] == ["pkg"]
    assert files.repo_files(spark, str(root / "nowhere"), "x").count() == 0


class Bag(BaseHTTPRequestHandler):
    """Bags of words as vectors, in reverse order."""

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        rows = []
        for k, text in enumerate(texts):
            v = [0.0] * 64
            for w in text.lower().replace("(", " ").replace(")", " ").split():
                v[sum(w.encode()) % 64] += 1
            rows.append({"index": k, "embedding": v})
        body = json.dumps({"data": rows[::-1]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_commands(spark, root, tmp_path, capsys):
    store = ["--store", str(tmp_path / "g")]
    told = lambda *a, code=0: (main([a[0], *store, *a[1:]]) == code, capsys.readouterr())
    ok, said = told("status")
    assert ok and said.out == "no graph\n"
    ok, said = told("build", str(root), "--notes", str(root / "docs" / "*.md"))
    assert ok and json.loads(said.out)["health"]["live"] > 10
    first = json.loads(said.out)["facts"]
    assert told("build", str(tmp_path / "nowhere"), code=1)[0]
    assert "run" in told("query", "--predicate", "called-by", "--subject", "parse")[1].out
    assert "test_parse tests pkg.core.parse" in told("query", "--predicate", "tests")[1].out
    assert "pkg/core.py" in told("explain", "parse")[1].out and "unknown" in told("explain", "nobody")[1].out
    task = "the parse function in core keeps raw white space"
    said = told("assist", task)[1]
    assert "`parse`" in said.out and "Always split" in said.out and "injected=True" in said.err and "twice" not in said.out
    empty = tmp_path / "empty"
    empty.mkdir()
    assert told("assist", task, "--workspace", str(empty))[1].out.strip() == task
    assert json.loads(told("status", "--repos", str(root))[1].out)["freshness"]["warnings"] == []
    assert told("tool", "graph_query", "{", code=2)[0] and "called-by" in told("tool", "graph_query", '{"subject": "parse"}')[1].out
    ok, said = told("watch", str(root))
    assert ok and "skip-unknown" in said.out and '"facts"' not in said.out
    ok, said = told("watch", str(root), "--force", "--notes", str(root / "docs" / "*.md"))
    assert ok and f'"facts": {first}' in said.out
    server = HTTPServer(("127.0.0.1", 0), Bag)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        ok, said = told("semantic-index", str(root), "--endpoint", url)
        assert ok and json.loads(said.out)["skipped"] == 0 and json.loads(said.out)["embedded"] >= 4
        again = json.loads(told("semantic-index", str(root), "--endpoint", url)[1].out)
        assert again["embedded"] == 0
        said = told("assist", "text.split() is wrong", "--endpoint", url)[1]
        assert "pkg/core.py:1" in said.out and "lexical_hits=0" in said.err
    finally:
        server.shutdown()
    said = told("assist", task, "--endpoint", "http://127.0.0.1:9/v1")[1]
    assert "`parse`" in said.out and "semantic_hits=0" in said.err
    assert told("semantic-index", str(root), "--endpoint", "http://127.0.0.1:9/v1", "--model", "other", code=1)[0]


def test_the_server_outlives_what_it_is_asked(spark):
    call = lambda **p: json.dumps({"id": 1, "method": "tools/call", "params": p})
    lines = [call(name="graph_query", arguments=[1]), call(name="nope"), json.dumps({"id": 2, "method": "ping", "params": [1]}), json.dumps({"id": 3, "method": ["x"]}), call(name="graph_assist", arguments={"task": "t", "workspace": "/nowhere"})]
    out = io.StringIO()
    rpc.serve(spark, None, lines, out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["result"]["isError"] for r in (replies[0], replies[1], replies[4])] == [False, False, False] or replies[0]["result"]["isError"]
    assert replies[2]["error"]["code"] == -32602 and replies[3]["error"]["code"] == -32601
    assert replies[4]["result"]["content"][0]["text"] == "t"


def test_caps_that_bind_are_logged(spark, caplog):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "src string, dst string")
    with caplog.at_level(logging.WARNING):
        assert derive.transitive_depends(edges, total=100).count() == 14 and not caplog.records
        assert derive.transitive_depends(edges, total=3).count() == 3
        assert derive.reaches(edges, 4, per_source=1, total=2).count() == 2
    assert [r.getMessage() for r in caplog.records] == ["transitive dependencies: cap of 3 rows drops 11", "reaches: 4 sources have more than 1", "reaches: cap of 2 rows drops 3"]
    known = edges.selectExpr("'calls' as predicate", "src", "dst", "cast(null as string) as repo")
    with caplog.at_level(logging.WARNING):
        assert [r.dst for r in derive.inverse(known, total=1).collect()] == ["n0"]


def test_public_names():
    assert all(hasattr(factloom, name) for name in factloom.__all__) and len(factloom.__all__) >= 8
