"""Parent-child links to full hierarchies: paths, depths, roots, descendants, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.stage import drop, stage, together

#: Levels joined one by one; what lies deeper is found by pointer doubling.
LEVELS = 64
#: Levels after which the links of settled nodes leave the join (doubling, so each link is rewritten a few times at most).
SHRINK_AT = {4, 8, 16, 32}


def links(df: DataFrame, node: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """One ``(node, parent)`` row per distinct non-null node; parent null for a root.

    Repeated rows count once; among different parents of one node the smallest
    existing one holds.  A null or empty parent, or one that is no node, makes a root.
    """
    rows = df.select(F.col(node).alias("node"), F.nullif(F.col(parent), F.lit("")).alias("parent")).where("node is not null")
    named = rows.where("parent is not null")
    nodes = rows.select(F.col("node").alias("known"))
    real = named.join(nodes, F.col("parent") == F.col("known"), "left_semi")
    kept = rows.select("node", F.lit(None).cast("string").alias("parent")).unionByName(real)
    return kept.groupBy("node").agg(F.min("parent").alias("parent"))


def hierarchy(df: DataFrame, node: str = "unit_id", parent: str = "parent_id", separator: str | None = None) -> DataFrame:
    """``(node, parent, root, depth, path, cyclic)`` for every distinct node.

    Level-wise frontier joins: the roots are level 0; level ``d+1`` is the join of
    the links on the frontier of level ``d``; links of settled nodes leave the
    table at doubling depths.  A parent with very many children is a skewed key
    of the links' side only, which AQE splits.  Levels are tables that are read
    as one, so plans don't grow with the depth.  What :data:`LEVELS` levels
    don't reach hangs deeper or on a cycle, which pointer doubling tells apart
    in a logarithmic number of rounds.  On a cycle or below one: depth -1,
    ``root`` the smallest node on that cycle, path null.

    ``separator``: joins the ids of ``path`` (root first); None leaves paths out.
    Empty input gives no rows; null nodes are dropped; depth is unbounded.
    """
    table = stage(links(df, node, parent), "links")
    paths = separator is not None
    columns = ["node", "parent", "root", "depth", *(["path"] if paths else [])]
    first = table.where("parent is null").select(
        "node", "parent", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.col("node").alias("path")] if paths else [])
    )
    size = F.count(F.lit(1))
    levels, left = [stage(first, "level", n=size)], table.where("parent is not null")
    while levels[-1].seen["n"] and len(levels) <= LEVELS:
        depth = len(levels)
        up = levels[-1].select(F.col("node").alias("parent"), "root", *(["path"] if paths else []))
        level = left.join(up, "parent").select(
            "node", "parent", "root", F.lit(depth).alias("depth"), *([F.concat_ws(separator, "path", "node").alias("path")] if paths else [])
        )
        levels.append(stage(level, "level", n=size))
        if depth in SHRINK_AT:
            left = stage(left.join(together(levels).select("node"), "node", "left_anti"), "links")
    reached = together(levels)
    rest = stage(left.join(reached.select("node"), "node", "left_anti"), "unreached", n=size)
    out = reached.select(*columns, F.lit(False).alias("cyclic"))
    if not rest.seen["n"]:
        return out
    deep = _doubled(rest, reached)
    acyclic = deep.where("done").select("node", "parent", "root", "depth")
    if paths:
        acyclic = _with_paths(stage(acyclic, "deep", n=size), reached, separator)
    # every pointer that never ends is on its cycle by now, and the least id it passed is that of the whole cycle
    endless = deep.where("not done")
    lows = endless.select(F.col("node").alias("to"), F.col("low").alias("smallest"))
    cyclic = endless.join(lows, "to").select("node", "parent", F.col("smallest").alias("root"), F.lit(-1).alias("depth"), *([F.lit(None).cast("string").alias("path")] if paths else []))
    return out.unionByName(acyclic.select(*columns, F.lit(False).alias("cyclic"))).unionByName(cyclic.select(*columns, F.lit(True).alias("cyclic")))


def _doubled(rest: DataFrame, reached: DataFrame) -> DataFrame:
    """``(node, parent, to, steps, low, done, root, depth)`` of unreached nodes: done with root and depth, or endless.

    A pointer jumps as far as its target's pointer does, until it ends at a settled
    node; what 2^k >= n steps don't settle is on a cycle or below one.
    """
    settled = reached.select(F.col("node").alias("parent"), F.col("root").alias("r"), F.col("depth").alias("d"))
    hop = rest.join(settled, "parent", "left").select(
        "node", "parent", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"), F.least("node", "parent").alias("low"),
        F.col("r").isNotNull().alias("done"), F.col("r").alias("root"), (F.col("d") + 1).alias("depth"))
    hop = stage(hop, "hop", open=F.count(F.when(~F.col("done"), 1)))
    steps, most = 1, hop.seen["open"]
    while hop.seen["open"] and steps < most:
        nxt = hop.select(F.col("node").alias("to"), *(F.col(c).alias(f"n_{c}") for c in ("to", "steps", "low", "done", "root", "depth")))
        moved = hop.where("not done").join(nxt, "to").select(
            "node", "parent", F.when(F.col("n_done"), F.col("to")).otherwise(F.col("n_to")).alias("to"), (F.col("steps") + F.when(F.col("n_done"), F.lit(0)).otherwise(F.col("n_steps"))).alias("steps"),
            F.least("low", "n_low").alias("low"), F.col("n_done").alias("done"), F.col("n_root").alias("root"), (F.col("n_depth") + F.col("steps")).cast("int").alias("depth"))
        old = hop
        hop = stage(hop.where("done").unionByName(moved), "hop", open=F.count(F.when(~F.col("done"), 1)))
        drop(old)
        steps *= 2
    return hop


def _with_paths(deep: DataFrame, reached: DataFrame, separator: str) -> DataFrame:
    """Adds ``path`` to nodes below the reached ones: segments double until they begin at a reached node."""
    held = reached.select(F.col("node").alias("parent"), F.col("path").alias("above"))
    hop = deep.join(held, "parent", "left").select("*", F.col("parent").alias("to"), F.concat_ws(separator, "above", "node").alias("segment"), F.col("above").isNotNull().alias("whole")).drop("above")
    hop = stage(hop, "hop", open=F.count(F.when(~F.col("whole"), 1)))
    while hop.seen["open"]:
        nxt = hop.select(F.col("node").alias("to"), F.col("to").alias("n_to"), F.col("segment").alias("n_segment"), F.col("whole").alias("n_whole"))
        moved = hop.where("not whole").join(nxt, "to").select("node", "parent", "root", "depth", F.col("n_to").alias("to"), F.concat_ws(separator, "n_segment", "segment").alias("segment"), F.col("n_whole").alias("whole"))
        old = hop
        hop = stage(hop.where("whole").select(*moved.columns).unionByName(moved), "hop", open=F.count(F.when(~F.col("whole"), 1)))
        drop(old)
    return hop.select("node", "parent", "root", "depth", F.col("segment").alias("path"))


def descendants(df: DataFrame, node: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """``(ancestor, node, distance)`` for every proper ancestor of every acyclic node.

    The path of a node names its ancestors, so one explode gives all pairs.
    """
    rows = hierarchy(df, node, parent, separator="\x1f").where("not cyclic")
    chain = rows.select("node", F.split("path", "\x1f").alias("chain"))
    pairs = chain.select("node", F.size("chain").alias("n"), F.posexplode("chain").alias("at", "ancestor"))
    return pairs.where("at < n - 1").select("ancestor", "node", (F.col("n") - 1 - F.col("at")).alias("distance"))


def children_ranked(df: DataFrame, node: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """Children of each node in id order, with their position."""
    rows = links(df, node, parent).where("parent is not null")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy("node")))
