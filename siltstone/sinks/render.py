"""Text artefacts, made on the driver from bounded tables: graph file, report, page, evidence package."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import communities as C
from siltstone.operators import graph as G


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, root: str, **extra) -> str:
    """Graph file of schema version 1, nodes by id and edges by source, target, key; only inside ``root``.

    Rows are serialised by the executors and streamed to the file partition by
    partition, never collected as a whole.
    """
    target, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([target, base]) != base:
        raise ValueError("the output must lie inside the root")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = target + ".part"
    with open(part, "w", encoding="utf-8") as f:
        f.write('{"schema_version": 1, "generator": "siltstone"')
        for k, v in extra.items():
            f.write(f", {json.dumps(k)}: {json.dumps(v)}")
        for name, rows in (("nodes", nodes.orderBy("id")), ("edges", edges.orderBy("source", "target", "key"))):
            f.write(f', "{name}": [')
            for i, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator()):
                f.write(("," if i else "") + "\n" + r[0])
            f.write("]")
        f.write("}\n")
    os.replace(part, target)
    return target


def report(name: str, nodes: DataFrame, edges: DataFrame, member: DataFrame, limit: int = 12) -> str:
    """Markdown report of a clustered graph (nodes: node_id, node_type, label, path; edges with confidence_label)."""
    central = G.central(edges, nodes, limit).collect()
    groups = C.summary(nodes, edges, member).orderBy(F.desc("size"), "community").limit(limit).collect()
    across = C.crossings(nodes, edges, member, limit).collect()
    n_nodes, n_edges, n_groups = nodes.count(), edges.count(), member.select("community").distinct().count()
    lines = [f"# {name}: graph", "", f"{n_nodes:,} nodes, {n_edges:,} relationships, {n_groups:,} communities.", ""]
    if "confidence_label" in edges.columns:
        lines += ["Confidence: " + ", ".join(f"{r[0]} {r[1]:,}" for r in G.histogram(edges, "confidence_label").collect()) + ".", ""]
    lines += ["## Central nodes", "", "| node | kind | degree | file |", "|---|---|---:|---|"]
    lines += [f"| `{r.label}` | {r.node_type} | {r.degree} | {r.path or 'external'} |" for r in central]
    lines += ["", "## Communities", ""]
    lines += [f"- {r.community}. **{r.label}** ({r['size']}): " + ", ".join(f"`{x}`" for x in r.top_nodes) for r in groups]
    lines += ["", "## Between communities", "", "| from | relation | to |", "|---|---|---|"]
    lines += [f"| `{r.source}` | {r.edge_type} | `{r.target}` |" for r in across]
    asked = C.questions([r.label for r in central], [r.label for r in groups], (across[0].source, across[0].target, across[0].edge_type) if across else None)
    lines += ["", "## Questions", "", *(f"- {q}" for q in asked), "", "EXTRACTED stands in the source, INFERRED was resolved, AMBIGUOUS has several targets.", ""]
    return "\n".join(lines)


def page(name: str, nodes: DataFrame, edges: DataFrame, most: int = 700) -> str:
    """A self-contained SVG page of the nodes of highest degree."""
    at = {r.node_id: r for r in G.layout(nodes, edges, most=most).collect()}
    inner = G.inside(edges, G.central(edges, nodes, most)).select("source_id", "target_id", "edge_type").limit(20 * most).collect()
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(name)}</title><svg viewBox='0 0 1000 1000' xmlns='http://www.w3.org/2000/svg'>"]
    for e in inner:
        a, b = at.get(e.source_id), at.get(e.target_id)
        if a and b:
            out.append(f"<line x1={a.x} y1={a.y} x2={b.x} y2={b.y} stroke='#999' stroke-width='.4'><title>{html.escape(e.edge_type)}</title></line>")
    for r in at.values():
        out.append(f"<circle cx={r.x} cy={r.y} r='{2 + min(8, r.degree ** 0.5):.1f}'><title>{html.escape(r.label or '')}</title></circle>")
        if r.labelled:
            out.append(f"<text x={r.x} y={r.y} font-size='9'>{html.escape(r.label or '')}</text>")
    return "".join(out) + "</svg>\n"


def estimated_tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def package_markdown(p: dict) -> str:
    """Markdown of an evidence package (see :meth:`siltstone.engine.Engine.compile`)."""
    lines = ["# Evidence", "", f"Task: {p['task']}", f"Repository: {p['repository']}", f"Budget: {p['estimated_tokens']} of {p['token_budget']} tokens",
             f"Route: {p['task_type']} by {', '.join(p['selected_sources']) or 'nothing'}", "", "## Source", ""]
    if not p["items"]:
        lines += ["Nothing was selected.", ""]
    for i in p["items"]:
        fence = "```" if "```" not in i["content"] else "````"
        lines += [f"### `{i['symbol']}`", "", f"`{i['file']}:{i['start_line']}-{i['end_line']}`, score {i['score']:.3f}, {i['estimated_tokens']} tokens, {', '.join(i['retrieved_by'])}", "",
                  i["why_selected"], "", f"{fence}{i['language'] or ''}", i["content"].rstrip(), fence, ""]
    if p["commits"]:
        lines += ["## History", "", *(f"- `{c['commit_hash'][:10]}` {c['message']} ({c['score']:.3f})" for c in p["commits"]), ""]
    if p["hotspots"]:
        lines += ["Often changed: " + ", ".join(f"`{path}` ({n})" for path, n in p["hotspots"]) + ".", ""]
    if p["concepts"]:
        lines += ["Searched once more with: " + ", ".join(p["concepts"]) + ".", ""]
    return "\n".join(lines).rstrip() + "\n"


def package_json(p: dict) -> str:
    return json.dumps(p, indent=2, default=str, ensure_ascii=False) + "\n"
