"""Queries over edge tables: neighbourhoods, paths, degrees, explanations, subgraphs.

Edges have ``source_id, target_id, edge_type, confidence``; nodes ``node_id,
node_type, label``.  A loop's frontier is a table; only one-row tests reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.fuzzy import weighted_ratio_udf
from siltstone.plans.stage import spread, stage, together


def both_ways(edges: DataFrame, edge_types=None) -> DataFrame:
    """``(at, to, edge_type, confidence, direction)``: each edge seen from both ends."""
    e = edges if not edge_types else edges.where(F.col("edge_type").isin(*edge_types))
    out = e.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "edge_type", "confidence", F.lit("outgoing").alias("direction"))
    back = e.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), "edge_type", "confidence", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def linked(edges: DataFrame, nodes: DataFrame, node_id: str, *, incoming: bool, edge_type: str = "calls") -> DataFrame:
    """Nodes with an edge of a type into (or from) a node, most confident first."""
    here, there = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    hit = edges.where((F.col(here) == node_id) & (F.col("edge_type") == edge_type)).select(F.col(there).alias("node_id"), "confidence")
    return nodes.join(hit, "node_id").orderBy(F.desc("confidence"), "node_id")


def callers(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    return linked(edges, nodes, node_id, incoming=True)


def callees(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    return linked(edges, nodes, node_id, incoming=False)


def edges_of(edges: DataFrame, node_id: str) -> DataFrame:
    """All edges of a node with their direction, most confident first."""
    rows = both_ways(edges).where(F.col("at") == node_id)
    return rows.select("direction", F.col("to").alias("other_id"), "edge_type", "confidence").orderBy("direction", F.desc("confidence"), "other_id")


def neighbors(edges: DataFrame, starts: DataFrame, *, nodes: DataFrame | None = None, edge_types=None, max_depth: int = 1, limit: int = 40) -> DataFrame:
    """``(start, node_id, distance, edge_type, direction, confidence, place)`` around every start.

    Bounded breadth-first search from all rows of ``starts`` (column ``start``)
    at once, in both directions.  A node is reached by its first discovery:
    parents in their own order, then edges by confidence, other id, direction;
    ``confidence`` is the product along that path, ``place`` the order of
    discovery up to ``limit`` per start.  Level by level: frontier join edges,
    rank, anti-join of the visited.  A hub's links are cut to the first
    ``limit`` before they are shuffled, since no later one can have a place.
    """
    hops = both_ways(edges, edge_types)
    if nodes is not None:
        hops = hops.join(nodes.select(F.col("node_id").alias("to")), "to", "left_semi")
    kept = ["start", "node_id", "distance", "edge_type", "direction", "confidence", "place"]
    none = lambda kind: F.lit(None).cast(kind)
    seen = starts.select("start").distinct().select("start", F.col("start").alias("node_id"), F.lit(0).alias("distance"), none("string").alias("edge_type"), none("string").alias("direction"), F.lit(1.0).alias("confidence"), F.lit(0).alias("place"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        up = frontier.select("start", F.col("node_id").alias("at"), F.col("confidence").alias("so_far"), F.col("place").alias("parent_place"))
        found = up.join(hops, "at").where(F.col("to") != F.col("start"))
        first = Window.partitionBy("start", "to").orderBy("parent_place", F.desc("confidence"), "direction", "edge_type")
        found = found.withColumn("n", F.row_number().over(first)).where("n = 1")
        found = found.join(seen.select("start", F.col("node_id").alias("to")), ["start", "to"], "left_anti")
        before = seen.groupBy("start").agg(F.max("place").alias("before"))
        order = Window.partitionBy("start").orderBy("parent_place", F.desc("confidence"), "to", "direction")
        found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
        found = found.join(before, "start").withColumn("place", F.col("before") + F.col("n")).where(F.col("place") <= limit)
        frontier = found.select("start", F.col("to").alias("node_id"), F.lit(depth).alias("distance"), "edge_type", "direction", (F.col("so_far") * F.col("confidence")).alias("confidence"), "place")
        if depth < max_depth:
            frontier = stage(frontier, "frontier")
            seen = stage(seen.unionByName(frontier), "seen")
        else:
            seen = seen.unionByName(frontier)
    return seen.where("distance > 0").select(*kept)


def within(edges: DataFrame, starts: DataFrame, max_depth: int, *, edge_types=None) -> DataFrame:
    """``(start, node_id, distance)`` of everything at most ``max_depth`` steps from each start, both ways, without a limit."""
    hops = both_ways(edges, edge_types).select("at", "to").distinct()
    levels = [stage(starts.select("start").distinct().select("start", F.col("start").alias("node_id"), F.lit(0).alias("distance")), "level")]
    for depth in range(1, max_depth + 1):
        found = levels[-1].select("start", F.col("node_id").alias("at")).join(hops, "at").select("start", F.col("to").alias("node_id")).distinct()
        found = found.join(together(levels).select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("distance", F.lit(depth))
        levels.append(stage(found, "level", n=F.count(F.lit(1))))
        if not levels[-1].seen["n"]:
            break
    return together(levels).where("distance > 0")


def _search(edges: DataFrame, source: str, target: str | None = None) -> list[DataFrame]:
    """Levels ``(node_id, hops, parent)`` of a breadth-first search ignoring direction, until the target or nothing new is found.

    One job per level: the write of a level also tells whether it is empty and has the target.
    """
    hops = stage(both_ways(edges).where("at <> to").select("at", "to").distinct(), "hops")
    kind = "node_id string, hops int, parent string"
    levels = [stage(edges.sparkSession.createDataFrame([(source, 0, None)], kind), "level")]
    found = source == target
    while not found:
        nxt = levels[-1].select(F.col("node_id").alias("at")).join(hops, "at").groupBy(F.col("to").alias("node_id")).agg(F.min("at").alias("parent"))
        # a neighbour of the last level lies in that level, the one before, or the next one
        known = together(levels[-2:]).select("node_id")
        new = nxt.join(known, "node_id", "left_anti").select("node_id", F.lit(len(levels)).alias("hops"), "parent")
        level = stage(new, "level", n=F.count(F.lit(1)), hit=F.count(F.when(F.col("node_id") == F.lit(target), 1)))
        if not level.seen["n"]:
            break
        levels.append(level)
        found = level.seen["hit"] > 0
    return levels


def hop_distances(edges: DataFrame, source: str) -> DataFrame:
    """``(node_id, hops, parent)`` of every node reachable from ``source`` ignoring direction; parent is the smallest id one step nearer."""
    return together(_search(edges, source))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``(step, source_id, target_id, edge_type, direction, confidence)`` of one shortest undirected path, however long.

    Search stops at the level that reaches the target.  A step shows its most
    confident edge and that edge's own direction.  No path: no rows.
    """
    spark = edges.sparkSession
    levels, chain, at = _search(edges, source, target), [], target
    if levels[-1].where(F.col("node_id") == target).isEmpty():
        levels = levels[:1]
    for level in reversed(levels[1:]):  # one row of each level
        before = level.where(F.col("node_id") == at).select("parent").first()[0]
        chain.append((before, at))
        at = before
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(reversed(chain), 1)], "step int, source_id string, target_id string")
    e = both_ways(edges).select(F.col("at").alias("source_id"), F.col("to").alias("target_id"), "edge_type", "direction", "confidence")
    best = Window.partitionBy("step").orderBy(F.desc("confidence"), "edge_type", "direction")
    rows = e.join(steps, ["source_id", "target_id"])  # a row per step: the planner broadcasts it while it is small
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("step", "source_id", "target_id", "edge_type", "direction", "confidence").orderBy("step")


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; no rows for an unknown one."""
    return nodes.where(F.col("node_id") == node_id).limit(1)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree)``: edge ends, parallel edges counted, a self-loop twice."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def central(edges: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """Nodes of the highest degree, ties by id; isolated ones have 0."""
    return nodes.join(degrees(edges), "node_id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "node_id").limit(limit)


def histogram(edges: DataFrame, column: str = "edge_type") -> DataFrame:
    return edges.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def inside(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends in ``chosen`` (column node_id)."""
    a = chosen.select(F.col("node_id").alias("source_id")).distinct()
    b = chosen.select(F.col("node_id").alias("target_id")).distinct()
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node (a sound graph has none)."""
    a = edges.join(nodes.select(F.col("node_id").alias("source_id")), "source_id", "left_anti")
    b = edges.join(nodes.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return a.unionByName(b).distinct()


def resolve(nodes: DataFrame, query: str, *, cutoff: float = 35.0) -> str | None:
    """Id of the node that a text names: exact id, label or qualified name first (smallest id), else the best fuzzy match."""
    q = query.strip().lower()
    if not q:
        raise ValueError("an empty query names no node")
    names = F.array("node_id", "label", *(["qualname"] if "qualname" in nodes.columns else []))
    exact = nodes.where(F.array_contains(F.transform(names, F.lower), q)).agg(F.min("node_id")).first()[0]
    if exact is not None:
        return exact
    text = F.array_join(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))), " ")
    best = spread(nodes, "node_id").select("node_id", weighted_ratio_udf(query)(text).alias("score")).where(F.col("score") >= cutoff).orderBy(F.desc("score"), "node_id").first()
    return best.node_id if best else None


def explain(edges: DataFrame, nodes: DataFrame, node_id: str, limit: int = 30) -> DataFrame:
    """A node's strongest relationships: by confidence, type, other label."""
    label = nodes.select(F.col("node_id").alias("other_id"), F.col("label").alias("other"))
    return edges_of(edges, node_id).join(label, "other_id").orderBy(F.desc("confidence"), "edge_type", "other", "direction").limit(limit)


def question_graph(edges: DataFrame, nodes: DataFrame, question: str, *, limit: int = 25, hops: int = 1, least: float = 20.0):
    """(nodes with place and distance, edges among them) around the three nodes that fit a question best.

    Anchors score at least ``least`` (else the best one); neighbours come by degree, then id.
    """
    if not question.strip():
        raise ValueError("an empty question")
    if not 1 <= limit <= 200 or not 0 <= hops <= 3:
        raise ValueError("limit 1..200 and hops 0..3")
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("label", "qualname", "path", "node_type") if c in nodes.columns]
    ranked = spread(nodes, "node_id").select("node_id", weighted_ratio_udf(question.strip())(F.concat_ws(" ", *fields)).alias("score")).orderBy(F.desc("score"), "node_id").limit(3).collect()
    anchors = [r.node_id for r in ranked if r.score >= least] or [r.node_id for r in ranked[:1]]
    spark = edges.sparkSession
    frontier = spark.createDataFrame(list(enumerate(anchors, 1)), "place int, node_id string").withColumn("distance", F.lit(0))
    seen, degree = frontier, degrees(edges)
    pairs = both_ways(edges).select("at", "to").distinct()
    for step in range(1, hops + 1):
        up = frontier.select(F.col("node_id").alias("at"), F.col("place").alias("parent_place"))
        found = up.join(pairs, "at").groupBy(F.col("to").alias("node_id")).agg(F.min("parent_place").alias("parent_place"))
        found = found.join(seen.select("node_id"), "node_id", "left_anti").join(degree, "node_id", "left").na.fill(0, ["degree"])
        order = Window.partitionBy(F.lit(0)).orderBy("parent_place", F.desc("degree"), "node_id")
        found = found.orderBy("parent_place", F.desc("degree"), "node_id").limit(limit)  # so the numbering below sees at most limit rows
        before = seen.agg(F.max("place").alias("before"))
        frontier = found.crossJoin(F.broadcast(before)).select((F.col("before") + F.row_number().over(order)).cast("int").alias("place"), "node_id", F.lit(step).alias("distance"))
        seen = seen.unionByName(frontier.where(F.col("place") <= limit))
    chosen = seen.where(F.col("place") <= limit)
    return chosen.join(nodes, "node_id").orderBy("place"), inside(edges, chosen)


def overview(nodes: DataFrame, edges: DataFrame, *, limit: int = 180, selected=(), anchors=()):
    """(nodes with ``selected`` and ``anchor`` flags, edges among them): the first ``limit`` nodes, containers first, then by label."""
    if not 1 <= limit <= 500:
        raise ValueError("limit 1..500")
    kinds = ("repository", "directory", "file", "module")
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("node_type")), F.lit(0).cast("long")), F.lit(len(kinds) + 1))
    flag = lambda ids: F.col("node_id").isin(*ids) if ids else F.lit(False)
    top = nodes.orderBy(order, "label", "node_id").limit(limit).withColumns({"selected": flag(list(selected)), "anchor": flag(list(anchors))})
    return top, inside(edges, top)


def layout(nodes: DataFrame, edges: DataFrame, *, most: int = 700) -> DataFrame:
    """``(node_id, label, degree, place, x, y, labelled)``: nodes of the highest degree on a circle.

    Of more than twelve nodes, a node is labelled if its degree reaches that of
    the node at a twelfth of the list.
    """
    top = central(edges, nodes, most)
    one = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "node_id")  # at most `most` rows
    all_rows = Window.partitionBy(F.lit(0))
    rows = top.withColumn("place", F.row_number().over(one) - 1).withColumn("n", F.count(F.lit(1)).over(all_rows))
    edge = F.max(F.when(F.col("place") == F.floor(F.col("n") / 12), F.col("degree"))).over(all_rows)
    angle = 2 * F.pi() * F.col("place") / F.col("n")
    return rows.select("node_id", "label", "degree", "place", F.bround(500 + 400 * F.cos(angle), 2).alias("x"), F.bround(500 + 400 * F.sin(angle), 2).alias("y"), (F.col("degree") >= edge).alias("labelled"))
