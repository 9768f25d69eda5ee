"""Communities by modularity, and summaries of clustered graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.graph import degrees
from siltstone.plans.stage import ranked, stage


def undirected(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``(a, b, weight)``, a < b: weights summed over both directions and parallel edges, self-edges dropped."""
    rows = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col(weight).cast("double").alias("weight"))
    return rows.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def components(pairs: DataFrame) -> DataFrame:
    """``(node_id, component)`` by min-label propagation with pointer jumping; ``component`` is its smallest node.

    Each round is two joins on node keys; the tables between rounds are written,
    nothing but a changed-or-not flag reaches the driver.
    """
    both = stage(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stage(both.groupBy(F.col("a").alias("node_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("low"))
        low = label.join(near, "node_id").select("node_id", F.least("component", "low").alias("low"), F.col("component").alias("old"))
        jump = label.select(F.col("node_id").alias("low"), F.col("component").alias("next"))
        new = stage(low.join(jump, "low").select("node_id", F.least("low", "next").alias("component"), "old"), "labels")
        if new.where("component <> old").isEmpty():
            return new.select("node_id", "component")
        label = new.select("node_id", "component")


#: Least gain of modularity for which another level is worth its rounds, and rounds of local moves per level.
LEAST_GAIN, ROUNDS = 1e-3, 6


def _moves(links: DataFrame, strength: DataFrame, total: float, level: int) -> DataFrame:
    """``(node, home)`` after rounds of local moves to the neighbouring community of largest gain.

    Gains are those of the whole graph (``total`` is the sum of all link ends).
    In each round a hashed half of the nodes may move, so that neighbours don't
    swap places for ever; a node alone joins another one alone only towards the smaller name.
    """
    home = strength.select("node", F.col("node").alias("home"), "k")
    others = stage(links.where("a <> b"), "links")
    for step in range(ROUNDS):
        sums = home.groupBy("home").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
        near = others.join(home.select(F.col("node").alias("b"), F.col("home").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
        here = home.join(sums.withColumnsRenamed({"tot": "own_tot", "size": "own_size"}), "home")
        rows = near.join(sums.withColumnRenamed("home", "to"), "to").join(here, F.col("a") == F.col("node"))
        same = F.col("to") == F.col("home")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(same, F.col("k")).otherwise(0.0)) / total
        alone = (F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("to") > F.col("home"))
        stay = F.coalesce(F.max(F.when(same, gain)), -F.first("k") * (F.first("own_tot") - F.first("k")) / total)
        best = F.max(F.when(~same & ~alone, F.struct(F.round(gain, 9).alias("gain"), F.col("to"))))
        picked = rows.groupBy("node").agg(best.alias("best"), stay.alias("stay"))
        turn = F.pmod(F.xxhash64("node", F.lit(level), F.lit(step)), F.lit(2)) == 0
        moving = turn & (F.col("best.gain") > F.col("stay") + 1e-9)
        new = home.join(picked, "node", "left").select("node", F.when(moving, F.col("best.to")).otherwise(F.col("home")).alias("home"), "k", F.coalesce(moving, F.lit(False)).alias("moved"))
        home = stage(new, "homes", moved=F.count(F.when(F.col("moved"), 1)), n=F.count(F.lit(1)))
        moved, n = home.seen["moved"], home.seen["n"]
        home = home.drop("moved")
        if step and moved * 50 <= n:
            break
    return home.select("node", "home")


def communities(nodes: DataFrame, edges: DataFrame, *, weight: str = "weight") -> DataFrame:
    """``(node_id, community)``; 0 is the largest community, ties by smallest member.

    Modularity of the whole graph by local moves and contraction (Blondel et
    al. 2008), the same at every size: each level moves nodes to the
    neighbouring community of largest gain, then communities become the nodes of
    the next level, until a level gains nothing.  All state is in tables;
    a round is joins and sums by node and community, and three numbers reach the
    driver.  Isolated nodes are communities of their own.
    """
    pairs = undirected(edges, weight)
    links = stage(pairs.select("a", "b", F.col("weight").alias("w")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").alias("w"))), "links", total=F.sum("w"))
    total = float(links.seen["total"] or 0.0)
    member, best, level = None, -1.0, 0
    while total > 0:
        strength = stage(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "strength")
        home = stage(_moves(links, strength, total, level).withColumn("low", F.min("node").over(Window.partitionBy("home"))).select("node", F.col("low").alias("home")), "homes")
        a, b = home.select(F.col("node").alias("a"), F.col("home").alias("ha")), home.select(F.col("node").alias("b"), F.col("home").alias("hb"))
        merged = links.join(a, "a").join(b, "b").groupBy(F.col("ha").alias("a"), F.col("hb").alias("b")).agg(F.sum("w").alias("w"))
        merged = stage(merged, "links", inner=F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)))
        squares = merged.groupBy("a").agg((F.sum("w") / total).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
        quality = merged.seen["inner"] / total - squares
        if quality < best + LEAST_GAIN:
            break
        step = home.select(F.col("node").alias("home"), F.col("home").alias("next"))
        member = stage(home.select(F.col("node").alias("node_id"), "home") if member is None else member.join(step, "home").select("node_id", F.col("next").alias("home")), "members")
        links, best, level = merged, quality, level + 1
    ids = nodes.select("node_id").distinct()
    homes = ids.withColumn("home", F.col("node_id")) if member is None else ids.join(member, "node_id", "left").select("node_id", F.coalesce("home", "node_id").alias("home"))
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("low"))
    number = ranked(sizes, [F.desc("size"), F.col("low")], "community").select("home", F.col("community").cast("int").alias("community"))
    return homes.join(number, "home").select("node_id", "community")


def summary(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """``(community, size, label, top_nodes)``: top five labels by degree; the label joins the first three that aren't external."""
    rows = nodes.join(member, "node_id").join(degrees(edges), "node_id", "left").na.fill(0, ["degree"])
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node_id")
    rows = rows.withColumn("place", F.row_number().over(w))
    own = rows.where("node_type <> 'external' and label <> ''").withColumn("k", F.row_number().over(w)).where("k <= 3")
    names = own.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), " / ").alias("label"))
    top = rows.where("place <= 5").groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("top_nodes"))
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(names, "community", "left").join(top, "community").select("community", "size", F.coalesce("label", F.lit("External dependencies")).alias("label"), "top_nodes")


def crossings(nodes: DataFrame, edges: DataFrame, member: DataFrame, limit: int = 12) -> DataFrame:
    """Edges between communities by the sum of their ends' degrees, then labels."""
    d = degrees(edges)
    end = nodes.select("node_id", "label").join(member, "node_id").join(d, "node_id")
    a = end.select(F.col("node_id").alias("source_id"), F.col("label").alias("source"), F.col("community").alias("ca"), F.col("degree").alias("da"))
    b = end.select(F.col("node_id").alias("target_id"), F.col("label").alias("target"), F.col("community").alias("cb"), F.col("degree").alias("db"))
    rows = edges.join(a, "source_id").join(b, "target_id").where("ca <> cb")
    return rows.select("source", "target", "edge_type", (F.col("da") + F.col("db")).alias("score")).orderBy(F.desc("score"), "source", "target", "edge_type").limit(limit)


def questions(central_labels: list[str], community_labels: list[str], crossing: tuple[str, str, str] | None) -> list[str]:
    """Suggested questions about a graph, at most five."""
    out = []
    if central_labels:
        out.append(f"What makes {central_labels[0]} central here?")
    if len(community_labels) > 1:
        out.append(f"How do {community_labels[0]} and {community_labels[1]} work together?")
    if crossing:
        out.append(f"How does {crossing[0]} come to {crossing[2]} {crossing[1]}?")
    out.append("Which relationships are ambiguous and need a second look?")
    return out[:5]


def modularity(pairs: DataFrame, member: DataFrame) -> float:
    """Modularity of a partition."""
    rows = pairs.join(member.select(F.col("node_id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("node_id").alias("b"), F.col("community").alias("cb")), "b")
    total, inner = rows.agg(F.sum("weight"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))).first()
    ends = rows.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg((F.sum("weight") / (2 * total)).alias("s"))
    return inner / total - ends.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
