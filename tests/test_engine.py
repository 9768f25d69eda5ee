import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.sinks import render
from siltstone.sources import files, records

SOURCES = {
    "app/__init__.py": "",
    "app/routing.py": 'from app.util import join_path\n\n\nclass Mount:\n    """Keep a prefix for an application."""\n\n    def __init__(self, prefix):\n        self.prefix = prefix\n\n    def resolve(self, path):\n        """Resolve a mounted path."""\n        return join_path(self.prefix, path)\n\n\ndef dispatch(mount, path):\n    return mount.resolve(path)\n',
    "app/util.py": "def join_path(a, b):\n    return a + '/' + b\n",
    "tests/test_routing.py": "from app.routing import Mount\n\n\ndef test_mount_keeps_prefix():\n    assert Mount('/api').resolve('x') == '/api/x'\n",
    "web/client.ts": 'import { send } from "./net";\n\nexport class Client {\n    load(url: string) {\n        return send(url);\n    }\n}\n',
    "worker/main.go": 'package main\n\nimport "fmt"\n\nfunc Run(n int) int {\n    fmt.Println(n)\n    return n\n}\n',
    "build/skip.py": "x = 1\n",
    "ignored.py": "x = 1\n",
    ".gitignore": "ignored.py\n",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    for name, text in SOURCES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "app/routing.py", "app/util.py", "app/__init__.py")
    run("commit", "-qm", "Add mount routing with a prefix")
    (root / "app/util.py").write_text(SOURCES["app/util.py"] + "\n")
    (root / "app/routing.py").write_text(SOURCES["app/routing.py"] + "\n")
    run("commit", "-qam", "Fix the lost prefix of a mounted path")
    return root


@pytest.fixture(scope="module")
def engine(spark, repository, tmp_path_factory):
    e = Engine(spark, str(repository), records.Settings(semantic_dimensions=64), store=str(tmp_path_factory.mktemp("store")))
    e.first = e.index()
    return e


def test_index_reads_python_and_history(engine):
    assert engine.first["new"] == 4 and engine.first["parse_errors"] == 0 and engine.first["history"]
    kinds = {r.node_type: r["count"] for r in engine.table("units").groupBy("node_type").count().collect()}
    assert kinds == {"file": 4, "module": 4, "class": 1, "method": 2, "function": 2, "test": 1}
    calls = {(r.source_id.rsplit(".", 1)[-1], r.target_id.rsplit(".", 1)[-1]) for r in engine.table("edges").where("edge_type = 'calls'").collect()}
    assert ("resolve", "join_path") in calls and ("dispatch", "resolve") in calls
    assert engine.table("edges").where("edge_type = 'tests'").count() >= 1
    assert engine.table("edges").where("edge_type = 'co_changed_with'").count() >= 1


def test_index_again_changes_nothing_and_errors_keep_old_units(engine, repository):
    assert engine.index() | {"history": True} == {"new": 0, "changed": 0, "unchanged": 4, "deleted": 0, "embedded": 0, "parse_errors": 0, "history": True}
    good = (repository / "app/util.py").read_text()
    (repository / "app/util.py").write_text("def broken(:\n")
    got = engine.index()
    assert got["changed"] == 1 and got["parse_errors"] == 1
    assert engine.table("units").where("name = 'join_path'").count() == 1
    (repository / "app/util.py").write_text(good)
    os.rename(repository / "tests/test_routing.py", repository / "aside")
    got = engine.index()
    assert got["deleted"] == 1 and engine.table("units").where("node_type = 'test'").count() == 0
    os.rename(repository / "aside", repository / "tests/test_routing.py")
    assert engine.index()["new"] == 1


def test_search_and_symbols(engine):
    top = engine.search("mounted prefix resolve", limit=5).collect()
    assert top[0].path in ("app/routing.py", "tests/test_routing.py") and [r.rank for r in top] == list(range(1, len(top) + 1))
    assert engine.search_symbols("join_path").first().name == "join_path"
    assert engine.status().count() == 6


@pytest.mark.parametrize("budget", [512, 800, 4000])
def test_packages_fit_their_budget(engine, budget):
    p = engine.compile("Fix the lost prefix of a mounted application", budget, as_of="2030-01-01")
    text = render.package_markdown(p)
    assert render.estimated_tokens(text) == p["estimated_tokens"] <= budget
    assert p["task_type"] == "cross_file_bug" and {d["unit_id"] for d in p["decisions"] if d["selected"]} == {i["unit_id"] for i in p["items"]}
    json.loads(render.package_json(p))
    if budget == 4000:
        assert any(i["file"] == "app/routing.py" for i in p["items"]) and p["commits"]


def test_no_retrieval_and_bad_budget(engine):
    assert engine.compile("do not search the repository")["items"] == []
    with pytest.raises(ValueError):
        engine.compile("x", 100)
    with pytest.raises(ValueError):
        engine.compile("x", 1000, without=("nothing",))


def test_map_writes_a_graph_that_reads_back(spark, engine, repository):
    out = repository / "out"
    got = engine.map(str(out))
    assert got["extractions"].where("size(parse_errors) > 0").count() == 0
    nodes, edges = records.read_graph(spark, str(out / "graph.json"))
    labels = {r.label for r in nodes.collect()}
    assert {"Client", "load", "Run", "Mount", "fmt"} <= labels and edges.where("relation = 'calls'").count() > 0
    assert "Central nodes" in (out / "report.md").read_text() and "<svg" in (out / "graph.html").read_text()
    with pytest.raises(ValueError):
        render.write_graph(nodes, edges, "/tmp/elsewhere.json", str(repository))
    broken = json.loads((out / "graph.json").read_text())
    broken["edges"][0]["target"] = "?"
    (out / "broken.json").write_text(json.dumps(broken))
    with pytest.raises(ValueError):
        records.read_graph(spark, str(out / "broken.json"))


def test_evaluation(spark, engine):
    tasks = spark.createDataFrame([("1", "lost prefix of a mounted path", ["app/routing.py"], ["app.routing.Mount.resolve"], [("app/routing.py", 10, 12)])], "id string, task string, gold_files array<string>, gold_symbols array<string>, gold_line_ranges array<struct<file:string,start_line:int,end_line:int>>")
    got = {r.configuration: r for r in engine.evaluate(tasks, top_k=5, configurations=("filename", "bm25_symbols", "hybrid_graph_history"), ablations=("semantic",)).collect()}
    assert got["full"].ablation == "semantic" and got["hybrid_graph_history"].package_file_recall == 1.0
    assert got["full"].package_file_recall == 1.0 and got["bm25_symbols"].mrr == 1.0


def test_ignore_rules():
    rules = files.IgnoreRules(["*.log", "!keep.log", "build/", "/top.py", "docs/**/x.md", "a?c"])
    assert [rules.ignored(p) for p in ("x.log", "d/x.log", "keep.log", "build/a.py", "src/build/a.py", "top.py", "d/top.py", "docs/q/r/x.md", "docs/x.md", "abc", "abcd")] == [True, True, False, True, True, True, False, True, True, True, False]


def test_records_and_settings(spark, tmp_path):
    p = tmp_path / "tasks.jsonl"
    p.write_text('{"id": "1", "task": "x", "gold_files": ["a"]}\n\n{"id": "2", "task": "y"}\n')
    assert records.read_tasks(spark, str(p)).count() == 2
    p.write_text('{"id": "1"}\nnonsense\n')
    with pytest.raises(ValueError, match="line 2"):
        records.read_tasks(spark, str(p))
    p.write_text("\n")
    with pytest.raises(ValueError):
        records.read_tasks(spark, str(p))
    good = {"id": "1", "repository_url": "https://example.org/a/b.git", "base_commit": "a" * 40, "fix_commit": "b" * 40, "task": "t", "gold_files": ["x/y.py"]}
    p.write_text(json.dumps(good) + "\n")
    assert records.read_patches(spark, str(p)).count() == 1
    p.write_text(json.dumps(good | {"gold_files": ["/x.py"]}) + "\n")
    with pytest.raises(ValueError, match="gold_files"):
        records.read_patches(spark, str(p))
    (tmp_path / "siltstone.toml").write_text("[siltstone]\ngraph_max_nodes = 7\n")
    assert records.Settings.load(str(tmp_path), {}).graph_max_nodes == 7
    assert records.Settings.load(str(tmp_path), {"SILTSTONE_GRAPH_MAX_NODES": "9"}).graph_max_nodes == 9
    (tmp_path / "siltstone.toml").write_text("unknown = 1\n")
    with pytest.raises(ValueError):
        records.Settings.load(str(tmp_path), {})
    with pytest.raises(ValueError):
        records.Settings(semantic_dimensions=8)
    assert records.git_log(spark, str(tmp_path)) is None


def test_discovery(spark, repository):
    got = {r.path: r.language for r in files.discover_all(spark, str(repository)).select("path", "language").collect()}
    assert got["web/client.ts"] == "typescript" and "ignored.py" not in got and "build/skip.py" not in got
    assert files.discover(spark, str(repository), most_bytes=10).where(F.col("size_bytes") > 10).count() == 0
