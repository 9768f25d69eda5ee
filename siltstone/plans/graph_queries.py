"""Queries of graph building, traversal, communities and source ingestion, with their SQL.

The edges come from the unit table itself: containment, and calls read from
the units' content by a native pattern and resolved by name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import communities as C
from siltstone.operators import graph as G
from siltstone.operators import graph_build as B
from siltstone.operators import history
from siltstone.sources import artifacts, files, python_units

from siltstone.plans.stage import is_staged, stage

from .tables import table

CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("


def call_hints(units):
    """Hints of the calls in functions, methods and tests: every name before an opening bracket."""
    rows = units.where("node_type in ('function', 'method', 'test') and content is not null")
    names = rows.select("unit_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)))).alias("target")).distinct()
    return names.select(F.col("unit_id").alias("source_id"), F.lit("calls").alias("edge_type"), "target", F.lit(0.65).alias("confidence"), F.lit(0).cast("long").alias("seq"))


_built: dict = {}


def _graph(spark, folder):
    """Nodes and edges, built and written once per session and folder for all plans that read them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built or not is_staged(_built[key][0]):
        units = table(spark, folder, "units")
        nodes, edges = B.build(units, call_hints(units), "corpus")
        _built[key] = stage(nodes, "nodes"), stage(edges, "edges")
    return _built[key]


def containment_edges(spark, folder):
    return B.containment(table(spark, folder, "units")).select("source_id", "target_id", "edge_type")


def resolve_cascade(spark, folder):
    units = table(spark, folder, "units")
    rows = B.resolve_hints(call_hints(units), units)
    return rows.select("source_id", "target", "target_id", F.round("confidence", 6).alias("confidence"))


def build_graph(spark, folder):
    nodes, edges = _graph(spark, folder)
    kinds = G.histogram(edges, "edge_type").select(F.concat(F.lit("edge:"), "edge_type").alias("kind"), "n")
    return kinds.unionByName(G.histogram(nodes, "node_type").select(F.concat(F.lit("node:"), "node_type").alias("kind"), "n"))


def test_edges(spark, folder):
    return _graph(spark, folder)[1].where("edge_type = 'tests'").select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


def callers(spark, folder):
    """Callers of the unit that most units call."""
    nodes, edges = _graph(spark, folder)
    calls = edges.where("edge_type = 'calls'").groupBy("target_id").count()
    top = calls.orderBy(F.desc("count"), "target_id").first()
    hit = G.callers(edges, nodes, top.target_id if top else "")
    return hit.select("node_id", "label", F.round("confidence", 6).alias("confidence"))


def degree_topk(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.central(edges, nodes, 20).select("node_id", "degree")


def explain_hub(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.explain(edges, nodes, "repository:.").select("other_id", "other", "direction", "edge_type")


def bounded_bfs(spark, folder):
    """Everything within two steps of every repository directory, both ways."""
    nodes, edges = _graph(spark, folder)
    starts = nodes.where("node_type = 'directory' and path not like '%/%'").select(F.col("node_id").alias("start"))
    return G.within(edges, starts, 2).select("start", "node_id", F.col("distance").cast("int").alias("distance"))


def bounded_bfs_limited(spark, folder):
    nodes, edges = _graph(spark, folder)
    starts = nodes.where("node_type = 'file'").select(F.col("node_id").alias("start"))
    return G.neighbors(edges, starts, nodes=nodes, max_depth=2, limit=10).select("start", "node_id", "distance", "place", F.round("confidence", 6).alias("confidence"))


def hop_distances(spark, folder):
    _, edges = _graph(spark, folder)
    return G.hop_distances(edges.where("edge_type = 'contains'"), "repository:.").select("node_id", F.col("hops").cast("int").alias("hops"))


def shortest_path(spark, folder):
    nodes, edges = _graph(spark, folder)
    ends = nodes.where("node_type = 'file'").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b")).first()
    return G.shortest_path(edges.where("edge_type = 'contains'"), ends.a or "", ends.b or "")


def case_ordered_graph(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.overview(nodes, edges)[0].select("node_id", "node_type", "label")


def inner_edges(spark, folder):
    """Edges among the directories of the graph."""
    nodes, edges = _graph(spark, folder)
    return G.inside(edges, nodes.where("node_type in ('directory', 'repository')")).select("source_id", "target_id", "edge_type")


def circular_layout(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.layout(nodes, edges).select("node_id", "degree", F.col("place").cast("int").alias("place"), "x", "y", "labelled")


def history_graph(spark, folder):
    units = table(spark, folder, "units")
    touched = history.commit_files(table(spark, folder, "commit_evidence"))
    return history.history_edges(touched, units).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def communities(spark, folder):
    nodes, edges = _graph(spark, folder)
    member = C.communities(nodes, edges, weight="confidence")
    return member.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("smallest"))


def connected_components(spark, folder):
    _, edges = _graph(spark, folder)
    return C.components(C.undirected(edges, "confidence"))


def undirected_weights(spark, folder):
    _, edges = _graph(spark, folder)
    return C.undirected(edges, "confidence").select("a", "b", F.round("weight", 6).alias("weight"))


def question_subgraph(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.question_graph(edges, nodes, "ranker snapshot limit", limit=25, hops=1)[0].select("place", "node_id", "distance")


def resolve_node(spark, folder):
    nodes, _ = _graph(spark, folder)
    asked = ["harborline", "merge_rankr_limit"]
    return spark.createDataFrame([(q, G.resolve(nodes, q)) for q in asked], "query string, node_id string")


def _sources(spark, folder):
    known = F.create_map(*(F.lit(x) for kv in files.LANGUAGES.items() for x in kv))
    rows = table(spark, folder, "units").where("node_type = 'file' and content is not null").select("path", "content").dropDuplicates(["path"])
    return rows.withColumn("language", known[F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))]).where("language is not null")


def python_units_read(spark, folder):
    """Units and hints of all Python files, and files that fail, counted per kind."""
    units, hints, errors = python_units.read(_sources(spark, folder).where("language = 'python'"))
    a = units.groupBy(F.concat(F.lit("unit:"), "node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = hints.groupBy(F.concat(F.lit("hint:"), "edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).unionByName(errors.agg(F.lit("error").alias("kind"), F.count(F.lit(1)).alias("n")))


def artifact_graph(spark, folder):
    """Resolved artefact graph of all source files: edges per relation and label, nodes per kind."""
    raw_nodes, raw_edges, _ = artifacts.extract(_sources(spark, folder))
    nodes, edges = B.resolve_artifacts(raw_nodes, raw_edges)
    a = edges.groupBy(F.concat_ws(":", "relation", "confidence").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(nodes.groupBy(F.concat(F.lit("node:"), "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def find_unit(spark, folder):
    units = table(spark, folder, "units")
    name = units.agg(F.min("qualname")).first()[0]
    return files.find_unit(units, name or "").select("unit_id", "qualname")


def scan_units(spark, folder):
    return files.scan_units(table(spark, folder, "units"), ("class", "test")).select("unit_id", "path", "start_line")


QUERIES = {f.__name__: f for f in (
    containment_edges, resolve_cascade, build_graph, test_edges, callers, degree_topk, explain_hub, bounded_bfs, bounded_bfs_limited, hop_distances, shortest_path, case_ordered_graph, inner_edges,
    circular_layout, history_graph, communities, connected_components, undirected_weights, question_subgraph, resolve_node, python_units_read, artifact_graph, find_unit, scan_units,
)}

_ONE = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY path) AS _n FROM units) WHERE _n = 1)"
_HOLD = r"CASE WHEN contains({0}, '/') THEN 'directory:' || regexp_replace({0}, '/[^/]*$', '') ELSE 'repository:.' END"
_CONTAIN = f"""{_ONE},
  dr AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT string_split(path, '/') AS s FROM u WHERE node_type = 'file'))),
  held AS (SELECT {_HOLD.format('path')} AS source_id, 'directory:' || path AS target_id, 'contains' AS edge_type FROM dr
    UNION ALL SELECT {_HOLD.format('path')}, unit_id, 'contains' FROM u WHERE node_type = 'file'
    UNION ALL SELECT parent_id, unit_id, CASE WHEN node_type = 'module' THEN 'contains' ELSE 'defines' END FROM u WHERE parent_id IN (SELECT unit_id FROM u))"""
_CALLS = f"""h AS (SELECT DISTINCT unit_id AS source_id, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS target FROM u WHERE node_type IN ('function', 'method', 'test') AND content IS NOT NULL),
  qn AS (SELECT qualname, min(unit_id) AS t FROM u GROUP BY qualname HAVING count(*) = 1), nm AS (SELECT name, min(unit_id) AS t FROM u GROUP BY name HAVING count(*) = 1),
  pn AS (SELECT path, name, min(unit_id) AS t FROM u GROUP BY path, name HAVING count(*) = 1),
  rs AS (SELECT h.source_id, h.target, coalesce(i.unit_id, qn.t, nm.t, pn.t) AS target_id, CASE WHEN i.unit_id IS NOT NULL OR qn.t IS NOT NULL THEN 1.0::DOUBLE WHEN nm.t IS NOT NULL THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END * 0.65::DOUBLE AS confidence
    FROM h JOIN u s ON s.unit_id = h.source_id LEFT JOIN u i ON i.unit_id = h.target LEFT JOIN qn ON qn.qualname = h.target LEFT JOIN nm ON nm.name = h.target LEFT JOIN pn ON pn.path = s.path AND pn.name = h.target),
  ok AS (SELECT * FROM rs WHERE target_id IS NOT NULL AND target_id <> source_id)"""
_GRAPH = f"""{_CONTAIN}, {_CALLS},
  nodes AS (SELECT 'repository:.' AS node_id, 'repository' AS node_type, 'corpus' AS label, '.' AS path UNION ALL SELECT 'directory:' || path, 'directory', string_split(path, '/')[-1], path FROM dr UNION ALL SELECT unit_id, node_type, qualname, path FROM u),
  e0 AS (SELECT source_id, target_id, edge_type, 1.0::DOUBLE AS confidence FROM held UNION ALL SELECT source_id, target_id, 'calls', max(confidence) FROM ok GROUP BY source_id, target_id),
  edges AS (SELECT * FROM e0 UNION ALL SELECT e.source_id, e.target_id, 'tests', e.confidence * 0.9::DOUBLE FROM e0 e JOIN nodes a ON a.node_id = e.source_id JOIN nodes b ON b.node_id = e.target_id WHERE e.edge_type = 'calls' AND a.node_type = 'test' AND b.node_type <> 'test'),
  deg AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY node_id),
  ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges)"""

ORACLES = {
    "containment_edges": f"WITH {_CONTAIN} SELECT source_id, target_id, edge_type FROM held",
    "resolve_cascade": f"WITH {_GRAPH} SELECT source_id, target, target_id, round(confidence, 6) AS confidence FROM ok",
    "build_graph": f"WITH {_GRAPH} SELECT 'edge:' || edge_type AS kind, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT 'node:' || node_type, count(*) FROM nodes GROUP BY 1",
    "test_edges": f"WITH {_GRAPH} SELECT source_id, target_id, round(confidence, 6) AS confidence FROM edges WHERE edge_type = 'tests'",
    "callers": f"""WITH {_GRAPH}, c AS (SELECT target_id FROM edges WHERE edge_type = 'calls' GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 1)
SELECT node_id, label, round(confidence, 6) AS confidence FROM edges JOIN c USING (target_id) JOIN nodes ON node_id = source_id WHERE edge_type = 'calls'""",
    "degree_topk": f"WITH {_GRAPH} SELECT node_id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id) ORDER BY degree DESC, node_id LIMIT 20",
    "explain_hub": f"WITH {_GRAPH} SELECT target_id AS other_id, label AS other, 'outgoing' AS direction, edge_type FROM edges JOIN nodes ON node_id = target_id WHERE source_id = 'repository:.' ORDER BY confidence DESC, edge_type, other LIMIT 30",
    "bounded_bfs": f"""WITH {_GRAPH}, s AS (SELECT node_id AS start FROM nodes WHERE node_type = 'directory' AND NOT contains(path, '/')),
  one AS (SELECT DISTINCT start, b AS node_id FROM s JOIN ways ON a = start WHERE b <> start), two AS (SELECT DISTINCT start, b AS node_id FROM one JOIN ways ON a = node_id WHERE b <> start)
SELECT start, node_id, CAST(1 AS INTEGER) AS distance FROM one UNION ALL SELECT start, node_id, CAST(2 AS INTEGER) FROM (SELECT * FROM two EXCEPT SELECT * FROM one)""",
    "hop_distances": f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT 'repository:.' AS node_id, 0 AS hops UNION ALL SELECT target_id, hops + 1 FROM r JOIN edges ON source_id = node_id AND edge_type = 'contains')
SELECT node_id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node_id""",
    "case_ordered_graph": f"WITH {_GRAPH} SELECT node_id, node_type, label FROM nodes ORDER BY CASE node_type WHEN 'repository' THEN 0 WHEN 'directory' THEN 1 WHEN 'file' THEN 2 WHEN 'module' THEN 3 ELSE 4 END, label, node_id LIMIT 180",
    "inner_edges": f"WITH {_GRAPH}, d AS (SELECT node_id FROM nodes WHERE node_type IN ('directory', 'repository')) SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT node_id FROM d) AND target_id IN (SELECT node_id FROM d)",
    "circular_layout": f"""WITH {_GRAPH}, t AS (SELECT node_id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id) ORDER BY degree DESC, node_id LIMIT 700),
  p AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node_id) - 1 AS place, count(*) OVER () AS n FROM t)
SELECT node_id, degree, CAST(place AS INTEGER) AS place, round_even(500 + 400 * cos(2 * pi() * place / n), 2) AS x, round_even(500 + 400 * sin(2 * pi() * place / n), 2) AS y, degree >= (SELECT degree FROM p WHERE place = n // 12) AS labelled FROM p""",
    "history_graph": f"""WITH {_ONE}, cf AS (SELECT DISTINCT commit_hash, path FROM (SELECT commit_hash, unnest(changed_files) AS path FROM commit_evidence) WHERE commit_hash IS NOT NULL AND coalesce(path, '') <> ''),
  f AS (SELECT DISTINCT path FROM u WHERE node_type = 'file'), g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY commit_hash) AS k FROM cf) WHERE k BETWEEN 2 AND 50),
  p AS (SELECT DISTINCT a.path AS x, b.path AS y FROM g a JOIN g b ON a.commit_hash = b.commit_hash AND a.path < b.path)
SELECT 'changed_in' AS edge_type, count(*) AS n FROM cf WHERE path IN (SELECT path FROM f) UNION ALL SELECT 'co_changed_with', count(*) FROM p WHERE x IN (SELECT path FROM f) AND y IN (SELECT path FROM f)""",
    "undirected_weights": f"WITH {_GRAPH} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, round(sum(confidence), 6) AS weight FROM edges WHERE source_id <> target_id GROUP BY 1, 2",
    "connected_components": f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
  r AS (SELECT 'repository:.' AS node_id UNION SELECT w.b FROM r JOIN w ON w.a = r.node_id),
  o AS (SELECT a AS node_id, a AS seen FROM w WHERE a NOT IN (SELECT node_id FROM r) UNION SELECT o.node_id, w.b FROM o JOIN w ON w.a = o.seen)
SELECT node_id, (SELECT min(node_id) FROM r) AS component FROM r WHERE node_id IN (SELECT a FROM w) UNION ALL SELECT node_id, min(seen) FROM o GROUP BY node_id""",
    "find_unit": f"WITH {_ONE} SELECT unit_id, qualname FROM u WHERE qualname = (SELECT min(qualname) FROM u) ORDER BY path, start_line, unit_id LIMIT 1",
    "scan_units": "SELECT unit_id, path, start_line FROM units WHERE node_type IN ('class', 'test')",
}
