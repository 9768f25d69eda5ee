"""Task routing, query evolution, structural expansion and related tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, query_terms_of
from siltstone.operators.fusion import SIGNAL
from siltstone.operators.graph import both_ways, neighbors

#: Phrases that ask for nothing, and phrases of each class in order of precedence.
NOTHING = ("no repository context", "do not search the repository")
CLASSES = {
    "documentation": ("readme", "documentation", "docstring", "docs/"),
    "dependency_change": ("dependency", "upgrade", "version conflict", "lockfile"),
    "test_change": ("write a test", "add test", "coverage", "flaky test"),
    "refactor": ("refactor", "rename", "extract", "move "),
    "bug": ("bug", "fix", "fails", "lost", "lose", "regression"),
    "feature": ("implement", "add support", "new feature", "introduce"),
}
CROSS_FILE = ("across", "between", "mounted", "routing", "integration", "sub-application", "call chain")
PAST = ("regression", "used to", "previous", "recent")
#: Sources of each class beyond lexical, symbol and (but for documentation) semantic.
EXTRA = {
    "call_graph": ("cross_file_bug", "feature", "refactor", "dependency_change"),
    "imports": ("cross_file_bug", "feature", "refactor", "dependency_change"),
    "inheritance": ("feature", "refactor"),
    "related_tests": ("cross_file_bug", "local_bug", "feature", "refactor", "test_change"),
    "git_history": ("cross_file_bug", "local_bug", "refactor", "dependency_change"),
    "hotspots": ("cross_file_bug", "local_bug", "refactor", "dependency_change"),
}
#: Weights of edge types in structural expansion, and the loss per step.
EDGE_WEIGHTS = {"calls": 1.0, "tests": 1.0, "imports": 0.82, "inherits": 0.88, "defines": 0.76, "references": 0.68, "contains": 0.55, "changed_in": 0.5, "co_changed_with": 0.55}
EXPANDED = ("calls", "imports", "inherits", "defines", "references", "tests")
STEP = 0.72
EDGE_SOURCE = {"calls": "call_graph", "imports": "import_graph", "inherits": "inheritance_graph", "tests": "related_tests"}


def _any(text: Column, phrases, whole_words: bool) -> Column:
    out = F.lit(False)
    for p in phrases:
        hit = text.rlike(r"(?<![a-z0-9])" + p.strip().replace("/", r"\/") + r"(?![a-z0-9])") if whole_words else text.contains(p)
        out = out | hit
    return out


def task_type(task: Column, *, whole_words: bool = False) -> Column:
    """Class of a task by the first class with one of its phrases; ``none`` if nothing is asked.

    Phrases are looked for anywhere ("fix" in "prefix" counts), or with
    ``whole_words`` as words of their own.
    """
    text = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    out = F.when((text == "") | _any(text, NOTHING, False), "none")
    for name, phrases in CLASSES.items():
        value = F.when(_any(text, CROSS_FILE, whole_words), "cross_file_bug").otherwise("local_bug") if name == "bug" else F.lit(name)
        out = out.when(_any(text, phrases, whole_words), value)
    return out.otherwise("general")


def sources(task: Column, kind: Column) -> Column:
    """Retrieval sources of a classified task, in order."""
    text = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    past = _any(text, PAST, False)
    out = [F.lit("lexical"), F.lit("symbol"), F.when(kind != "documentation", "semantic")]
    for source, kinds in EXTRA.items():
        hit = kind.isin(*kinds)
        out.append(F.when(hit | past if source in ("git_history", "hotspots") else hit, source))
    chosen = F.filter(F.array(*out), lambda x: x.isNotNull())
    return F.when(kind == "none", F.array().cast("array<string>")).otherwise(chosen)


def route(tasks: DataFrame, column: str = "task", **options) -> DataFrame:
    """Adds ``task_type`` and ``selected_sources``."""
    kind = task_type(F.col(column), **options)
    return tasks.withColumn("task_type", kind).withColumn("selected_sources", sources(F.col(column), F.col("task_type")))


def evolve(candidates: DataFrame, edges: DataFrame, nodes: DataFrame, task: str, *, max_anchors: int = 6, max_concepts: int = 12) -> list[str]:
    """New terms from the best candidates: three of a name, five of its signature, five of its docstring, three of each near label.

    Candidates need unit_id, name, signature, docstring, score.  At most
    ``max_anchors`` rows come to the driver, with up to eight neighbours each.
    """
    top = candidates.orderBy(F.desc("score"), "unit_id").limit(max_anchors)
    near = neighbors(edges, top.select(F.col("unit_id").alias("start")), nodes=nodes, edge_types=("calls", "imports", "inherits"), max_depth=1, limit=8)
    label = F.substring_index("label", ".", -1)
    terms = near.join(nodes.select("node_id", "label"), "node_id").groupBy(F.col("start").alias("unit_id")).agg(F.sort_array(F.collect_list(F.struct("place", query_terms(label, 3).alias("terms")))).alias("near"))
    rows = top.select("unit_id", "score", query_terms(F.col("name"), 3).alias("a"), query_terms(F.col("signature"), 5).alias("b"), query_terms(F.col("docstring"), 5).alias("c")).join(terms, "unit_id", "left").collect()
    seen, out = set(query_terms_of(task)), []
    for r in sorted(rows, key=lambda r: (-r.score, r.unit_id)):
        for t in [*r.a, *r.b, *r.c, *(t for n in r.near or () for t in n.terms)]:
            if t not in seen and len(t) > 2:
                seen.add(t)
                out.append(t)
    return out[:max_concepts]


def _weight(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv))
    return F.coalesce(table[kind], F.lit(0.0))


def expand(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, *, edge_types=EXPANDED, max_depth: int = 2, max_nodes: int = 40, anchors_limit: int = 8, seq: int = 0) -> DataFrame:
    """Signals of units around the best anchors ``(unit_id, strength)``.

    Score: anchor's strength x 0.72 per step x confidence of the path x weight of
    the last edge.  All anchors expand at once; the cap of ``max_nodes``
    discoveries is shared in order of the anchors, nodes without a unit count too.
    """
    if max_depth < 1 or max_nodes < 1:
        return anchors.sparkSession.createDataFrame([], SIGNAL)
    top = anchors.orderBy(F.desc("strength"), "unit_id").limit(anchors_limit)
    ranked = top.withColumn("anchor_place", F.row_number().over(Window.orderBy(F.desc("strength"), "unit_id")))  # at most anchors_limit rows
    near = neighbors(edges, ranked.select(F.col("unit_id").alias("start")), nodes=nodes, edge_types=edge_types, max_depth=max_depth, limit=max_nodes)
    rows = near.join(ranked.select(F.col("unit_id").alias("start"), "strength", "anchor_place"), "start")
    shared = rows.withColumn("n", F.row_number().over(Window.orderBy("anchor_place", "place"))).where(F.col("n") <= max_nodes)  # at most anchors_limit x max_nodes
    units = nodes.where("unit_id is not null").select("node_id", "unit_id")
    score = F.col("strength") * F.pow(F.lit(STEP), F.col("distance")) * F.col("confidence") * _weight(F.col("edge_type"))
    table = F.create_map(*(F.lit(x) for kv in EDGE_SOURCE.items() for x in kv))
    return shared.join(units, "node_id").select(
        "unit_id", F.coalesce(table[F.col("edge_type")], F.lit("graph_expansion")).alias("source"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        F.concat_ws(" ", "edge_type", "direction", F.lit("at distance"), "distance", F.lit("from"), "start").alias("reason"),
        F.col("distance").cast("int").alias("graph_distance"), "edge_type", F.lit(False).alias("exact"), (F.lit(seq) + F.col("n")).cast("long").alias("seq"))


def related_tests(anchors: DataFrame, units: DataFrame, edges: DataFrame, nodes: DataFrame, task: str = "", limit: int = 12) -> DataFrame:
    """``(unit_id, path, start_line, score)`` of tests that likely validate the anchors (columns of units).

    0.72 for a direct call, reference or test edge; 0.48 if an anchor or its file
    lies within three steps (40 nodes); 0.15 per anchor name in the test's name,
    at most 0.3; 0.04 per task term in its text, at most 0.2; at most 1.
    """
    text = F.lower(F.concat_ws(" ", "qualname", "docstring", "content"))
    said = sum((text.contains(t).cast("int") for t in query_terms_of(task)), F.lit(0))
    tests = units.where("node_type = 'test'").select("unit_id", "path", "start_line", "qualname", said.alias("said")).dropDuplicates(["unit_id"])
    ids = anchors.select(F.col("unit_id").alias("anchor")).distinct()
    ways = both_ways(edges, ("calls", "references", "tests"))
    direct = ways.join(ids, F.col("to") == F.col("anchor"), "left_semi").select(F.col("at").alias("unit_id")).distinct().withColumn("direct", F.lit(0.72))
    # who is within reach of an anchor is found from the anchors' side of each test's own search
    near = neighbors(edges, tests.select(F.col("unit_id").alias("start")), nodes=nodes, edge_types=("calls", "references", "imports", "defines", "tests"), max_depth=3, limit=40)
    places = nodes.select("node_id", "path")
    hit = near.join(places, "node_id")
    paths = anchors.select("path").distinct()
    by_id = hit.join(ids.select(F.col("anchor").alias("node_id")), "node_id", "left_semi").select("start")
    by_path = hit.join(paths, "path", "left_semi").select("start")
    bounded = by_id.unionByName(by_path).distinct().select(F.col("start").alias("unit_id"), F.lit(0.48).alias("bounded"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    names = anchors.select(F.explode(F.array(F.lower("name"), F.lower(stem))).alias("anchor_name")).where("length(anchor_name) > 2").distinct()
    named = tests.join(F.broadcast(names), F.lower("qualname").contains(F.col("anchor_name")))  # two names per anchor; anchors come from a limited search
    named = named.groupBy("unit_id").agg(F.least(F.lit(0.3), F.count(F.lit(1)) * 0.15).alias("named"))
    rows = tests.join(direct, "unit_id", "left").join(bounded, "unit_id", "left").join(named, "unit_id", "left").na.fill(0.0, ["direct", "bounded", "named"])
    rows = rows.withColumn("score", F.least(F.lit(1.0), F.col("direct") + F.col("bounded") + F.col("named") + F.least(F.lit(0.2), F.col("said") * 0.04)))
    return rows.where("score > 0").select("unit_id", "path", "start_line", "score").orderBy(F.desc("score"), "path", "start_line", "unit_id").limit(limit)
