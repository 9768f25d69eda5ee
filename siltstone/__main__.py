"""Command line: ``python -m siltstone VERB REPOSITORY ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name, *arguments, **options):
        v = verbs.add_parser(name)
        v.add_argument("repository")
        for a in arguments:
            v.add_argument(a)
        for o, (kind, default) in options.items():
            v.add_argument("--" + o.replace("_", "-"), type=kind, default=default)
        return v

    verb("index")
    verb("status")
    verb("search", "query", limit=(int, 20))
    verb("symbols", "query", limit=(int, 20))
    verb("history", "task", limit=(int, 8), as_of=(str, None))
    verb("neighbors", "node", depth=(int, 1), limit=(int, 40))
    verb("callers", "node")
    verb("callees", "node")
    verb("compile", "task", budget=(int, 8000), format=(str, "markdown"))
    verb("map", output=(str, "graph-out"))
    verb("query", "graph", "question", limit=(int, 25), hops=(int, 1))
    verb("path", "graph", "source", "target")
    verb("explain", "graph", "node", limit=(int, 30))
    verb("evaluate", "tasks", top_k=(int, 10), budget=(int, 8000))
    return p


def _graph(spark, path):
    from siltstone.sources.records import read_graph

    nodes, edges = read_graph(spark, path)
    nodes = nodes.withColumnsRenamed({"id": "node_id", "kind": "node_type", "source_file": "path"})
    return nodes.cache(), edges.withColumnsRenamed({"source": "source_id", "target": "target_id", "relation": "edge_type", "confidence": "label", "weight": "confidence"}).cache()


def main(argv=None, spark=None) -> int:
    a = parser().parse_args(argv)
    from siltstone.engine import Engine
    from siltstone.operators import graph as G
    from siltstone.sinks import render
    from siltstone.sources.records import read_tasks

    spark = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    e = Engine(spark, a.repository)
    say = lambda x: print(json.dumps(x, default=str, ensure_ascii=False))
    table = lambda df, *columns: [say(r.asDict(True)) for r in (df.select(*columns) if columns else df).collect()]
    if a.verb == "index":
        say(e.index())
    elif a.verb == "status":
        table(e.status())
    elif a.verb in ("search", "symbols"):
        found = e.search(a.query, a.limit) if a.verb == "search" else e.search_symbols(a.query, a.limit)
        table(found, "rank", "unit_id", "path", "start_line", "end_line", "score", "retrieved_by", "reasons")
    elif a.verb == "history":
        table(e.history(a.task, limit=a.limit, as_of=a.as_of))
    elif a.verb == "neighbors":
        table(e.neighbors(a.node, max_depth=a.depth, limit=a.limit).orderBy("place"))
    elif a.verb in ("callers", "callees"):
        table(getattr(e, a.verb)(a.node))
    elif a.verb == "compile":
        package = e.compile(a.task, a.budget)
        print(render.package_json(package) if a.format == "json" else render.package_markdown(package), end="")
    elif a.verb == "map":
        got = e.map(os.path.join(a.repository, a.output))
        say({"nodes": got["nodes"].count(), "edges": got["edges"].count(), "output": os.path.join(a.repository, a.output)})
    elif a.verb in ("query", "path", "explain"):
        nodes, edges = _graph(spark, a.graph)
        if a.verb == "query":
            for part in G.question_graph(edges, nodes, a.question, limit=a.limit, hops=a.hops):
                table(part)
        else:
            ends = [G.resolve(nodes, x) for x in ((a.source, a.target) if a.verb == "path" else (a.node,))]
            if None in ends:
                print("no such node", file=sys.stderr)
                return 1
            table(G.shortest_path(edges, *ends) if a.verb == "path" else G.explain(edges, nodes, ends[0], a.limit))
    else:
        table(e.evaluate(read_tasks(spark, a.tasks), top_k=a.top_k, token_budget=a.budget))
    return 0


if __name__ == "__main__":
    sys.exit(main())
