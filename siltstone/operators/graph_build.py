"""Building graphs from units and unresolved hints, and from extracted artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import directories, external_id, normal_reference, parent_directory

#: Certainty of each way of resolving a target, and of derived test edges.
EXACT, RELATIVE, BY_NAME, SAME_FILE, BY_MODULE, TESTS = 1.0, 0.9, 0.85, 0.8, 0.8, 0.9
#: Weights of the confidence labels.
LABEL_WEIGHTS = {"EXTRACTED": 1.0, "INFERRED": 0.72, "AMBIGUOUS": 0.4}
#: Fixed value: candidates kept of an ambiguous reference.
MOST_AMBIGUOUS = 5


def keep_last(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row (largest ``seq``) of each key: upsert semantics."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nodes_of(units: DataFrame, root_name: str = "repository") -> DataFrame:
    """``(node_id, node_type, path, label, unit_id)``: a repository node, its directories, and every unit."""
    one = units.dropDuplicates(["unit_id"])
    root = units.sparkSession.createDataFrame([("repository:.", "repository", ".", root_name, None)], "node_id string, node_type string, path string, label string, unit_id string")
    dirs = one.where("node_type = 'file'").select(F.explode(directories(F.col("path"))).alias("path")).distinct()
    dirs = dirs.select(F.concat(F.lit("directory:"), "path").alias("node_id"), F.lit("directory").alias("node_type"), "path", F.substring_index("path", "/", -1).alias("label"), F.lit(None).cast("string").alias("unit_id"))
    return root.unionByName(dirs).unionByName(one.select(F.col("unit_id").alias("node_id"), "node_type", "path", F.col("qualname").alias("label"), "unit_id"))


def containment(units: DataFrame) -> DataFrame:
    """``(source_id, target_id, edge_type, confidence)``: directory to parent, file to directory, unit to parent."""
    one = units.dropDuplicates(["unit_id"])
    files = one.where("node_type = 'file'")
    holder = lambda p: F.when(parent_directory(p) == ".", F.lit("repository:.")).otherwise(F.concat(F.lit("directory:"), parent_directory(p)))
    dirs = files.select(F.explode(directories(F.col("path"))).alias("path")).distinct()
    a = dirs.select(holder(F.col("path")).alias("source_id"), F.concat(F.lit("directory:"), "path").alias("target_id"), F.lit("contains").alias("edge_type"))
    b = files.select(holder(F.col("path")).alias("source_id"), F.col("unit_id").alias("target_id"), F.lit("contains").alias("edge_type"))
    known = one.select(F.col("unit_id").alias("parent_id"))
    kind = F.when(F.col("node_type") == "module", "contains").otherwise("defines")
    c = one.where("parent_id is not null").join(known, "parent_id", "left_semi").select(F.col("parent_id").alias("source_id"), F.col("unit_id").alias("target_id"), kind.alias("edge_type"))
    return a.unionByName(b).unionByName(c).withColumn("confidence", F.lit(1.0))


def resolve_hints(hints: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ``target_id`` and ``resolution`` (certainty) to hints ``(source_id, edge_type, target, confidence, seq)``.

    First hit of a cascade of equi-joins on pre-counted keys: unit id; unique
    qualified name; unique relative name (the source's package, one level up
    per extra dot); unique last name; a last name unique in the source's file;
    for imports a module that is the target or the only one below it.
    Unresolved hints and self-edges are left out.
    """
    one = units.dropDuplicates(["unit_id"]).select("unit_id", "name", "qualname", "path", "node_type")
    source = one.select(F.col("unit_id").alias("source_id"), F.col("qualname").alias("source_qualname"), F.col("path").alias("source_path"), F.col("node_type").alias("source_type"))
    rows = hints.join(source, "source_id", "left").withColumn("clean", F.regexp_replace("target", r"^\.+", ""))
    dots = F.length("target") - F.length("clean")
    # the package of a module is its qualified name without the last part; inside a unit the module comes first
    above = F.split("source_qualname", r"\.")
    rows = rows.withColumn("relative", F.when((dots > 0) & F.col("source_qualname").isNotNull(), F.concat_ws(".", F.slice(above, 1, F.greatest(F.lit(0), F.size(above) - dots)), F.nullif("clean", F.lit("")))))
    rows = rows.withColumn("last", F.substring_index("clean", ".", -1))

    def unique(keys, target):
        return one.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("unit_id").alias(target)).where("_n = 1").drop("_n")

    rows = rows.join(one.select(F.col("unit_id").alias("target"), F.col("unit_id").alias("t1")), "target", "left")
    rows = rows.join(unique(["qualname"], "t2").withColumnRenamed("qualname", "clean"), "clean", "left")
    # few hints are relative, so only those meet the names; the others would all hash to one place as nulls
    local = rows.where("relative is not null").join(unique(["qualname"], "t3").withColumnRenamed("qualname", "relative"), "relative", "left")
    rows = local.unionByName(rows.where("relative is null").withColumn("t3", F.lit(None).cast("string")))
    rows = rows.join(unique(["name"], "t4").withColumnRenamed("name", "last"), "last", "left")
    rows = rows.join(unique(["path", "name"], "t5").withColumnRenamed("path", "source_path").withColumnRenamed("name", "last"), ["source_path", "last"], "left")
    modules = one.where("node_type = 'module'")
    parts = F.split("qualname", r"\.")
    prefixes = modules.select("unit_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("clean"))
    below = prefixes.groupBy("clean").agg(F.count(F.lit(1)).alias("_n"), F.min("unit_id").alias("t6")).where("_n = 1").drop("_n")
    rows = rows.join(below, "clean", "left")
    imports = F.when(F.col("edge_type") == "imports", F.col("t6"))
    certainty = F.when(F.col("t1").isNotNull(), EXACT).when(F.col("t2").isNotNull(), EXACT).when(F.col("t3").isNotNull(), RELATIVE).when(F.col("t4").isNotNull(), BY_NAME).when(F.col("t5").isNotNull(), SAME_FILE).when(imports.isNotNull(), BY_MODULE)
    rows = rows.withColumn("target_id", F.coalesce("t1", "t2", "t3", "t4", "t5", imports)).withColumn("resolution", certainty)
    return rows.where("target_id is not null and target_id <> source_id").select("source_id", "target_id", "edge_type", "target", "resolution", (F.col("confidence") * F.col("resolution")).alias("confidence"), "seq")


def test_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A ``tests`` edge wherever a test calls or references something that is no test."""
    kind = nodes.select("node_id", "node_type")
    rows = edges.where(F.col("edge_type").isin("calls", "references"))
    rows = rows.join(kind.withColumnsRenamed({"node_id": "source_id", "node_type": "a"}), "source_id").join(kind.withColumnsRenamed({"node_id": "target_id", "node_type": "b"}), "target_id")
    rows = rows.where("a = 'test' and b <> 'test'")
    return rows.groupBy("source_id", "target_id").agg(F.lit("tests").alias("edge_type"), (F.max("confidence") * TESTS).alias("confidence"))


def build(units: DataFrame, hints: DataFrame, root_name: str = "repository") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository: containment, resolved hints (the last of a key holds) and derived test edges."""
    nodes = nodes_of(units, root_name)
    resolved = resolve_hints(hints, units).select("source_id", "target_id", "edge_type", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")).alias("confidence"), "seq")
    held = containment(units).withColumn("seq", F.lit(-1).cast("long"))
    edges = keep_last(held.unionByName(resolved.withColumn("seq", F.col("seq").cast("long"))), ["source_id", "target_id", "edge_type"]).drop("seq")
    tests = test_edges(edges, nodes).join(edges.where("edge_type = 'tests'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    return nodes, edges.unionByName(tests.select(*edges.columns))


# -- artefact graphs ----------------------------------------------------------


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(problem, n)``: missing fields, repeated ids, edges without a target, unknown labels or sources."""
    ids = nodes.select(F.col("id").alias("source"))
    checks = [
        ("node without id, label or kind", nodes.where("coalesce(id, '') = '' or coalesce(label, '') = '' or coalesce(kind, '') = ''")),
        ("repeated node id", nodes.groupBy("id").count().where("count > 1")),
        ("edge without source or relation", edges.where("coalesce(source, '') = '' or coalesce(relation, '') = ''")),
        ("edge without target or reference", edges.where("coalesce(target, '') = '' and coalesce(target_ref, '') = ''")),
        ("unknown confidence label", edges.where(~F.coalesce(F.col("confidence").isin(*LABEL_WEIGHTS), F.lit(False)))),
        ("edge from an unknown node", edges.join(ids, "source", "left_anti")),
    ]
    out = None
    for name, rows in checks:
        part = rows.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def resolve_artifacts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every reference resolved.

    Nodes: id, label, kind, qualname, source_file, language.  Edges: source,
    target (or null), target_ref, relation, confidence label, source_location.
    Candidates of a reference are nodes of that qualified name, for imports
    also files of that module or stem, and nodes labelled with its last name.  One
    candidate (or the only one in the source's file) makes the edge, INFERRED
    for calls and inherits; several make up to five AMBIGUOUS ones; none makes
    an external node.  A name that thousands share is a list of its five
    smallest nodes before it meets the references, so no hot name makes pairs.
    """
    edges = edges.select("source", F.nullif("target", F.lit("")).alias("target"), F.coalesce("target_ref", F.lit("")).alias("target_ref"), "relation", "confidence", "source_location")
    ids = nodes.select(F.col("id").alias("target"))
    direct = edges.join(ids, "target", "left_semi").select("source", "target", "relation", "confidence", "source_location", "target_ref")
    open_ = edges.join(ids.withColumn("known", F.lit(1)), "target", "left").where("known is null").drop("known", "target")
    open_ = open_.withColumn("whole", normal_reference(F.col("target_ref"))).withColumn("last", normal_reference(F.substring_index(F.substring_index("target_ref", ".", -1), "::", -1)))
    names = nodes.select(F.col("id").alias("candidate"), F.col("source_file").alias("file"), normal_reference(F.col("label")).alias("n_label"), normal_reference(F.col("qualname")).alias("n_qualname"), "kind")
    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    modules = names.where("kind = 'file'").select("candidate", "file", F.explode(F.array(normal_reference(stem), normal_reference(F.substring_index(stem, "/", -1)))).alias("key")).distinct()
    keyed = {"whole": names.where("n_qualname <> ''").select("candidate", "file", F.col("n_qualname").alias("key")), "imports": modules,
             "last": names.where("n_label <> ''").select("candidate", "file", F.col("n_label").alias("key"))}
    here = nodes.select(F.col("id").alias("source"), F.col("source_file").alias("file")).dropDuplicates(["source"])
    rows = open_.join(here, "source", "left")

    def fewest(table, keys, most, name):
        """The ``most`` smallest candidates of each key: a name that thousands share is cut before it is shuffled."""
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("candidate"))
        few = table.select(*keys, "candidate").distinct().withColumn("n_", place).where(F.col("n_") <= most)
        return few.groupBy(*keys).agg(F.sort_array(F.collect_list("candidate")).alias(name))

    for way, table in keyed.items():
        side = "last" if way == "last" else "whole"
        rows = rows.join(fewest(table, ["key"], MOST_AMBIGUOUS, f"any_{way}").withColumnRenamed("key", side), side, "left")
        rows = rows.join(fewest(table, ["key", "file"], 2, f"own_{way}").withColumnRenamed("key", side), [side, "file"], "left")
    none = F.array().cast("array<string>")

    def joined(prefix):
        """Candidates by any way; those of module names count for imports only."""
        modules_ = F.when(F.col("relation") == "imports", F.coalesce(f"{prefix}_imports", none)).otherwise(none)
        return F.array_sort(F.array_union(F.array_union(F.coalesce(f"{prefix}_whole", none), modules_), F.coalesce(f"{prefix}_last", none)))

    # the smallest five of a union are among the smallest five of its parts, and one is the only one if the parts' shortest lists agree
    rows = rows.withColumn("any_", joined("any")).withColumn("own_", joined("own"))
    chosen = F.when(F.size("own_") == 1, F.col("own_")).otherwise(F.slice("any_", 1, MOST_AMBIGUOUS))
    found = rows.withColumn("chosen", chosen).where("size(chosen) > 0").select("*", F.explode("chosen").alias("candidate"))
    label = F.when(F.size("chosen") > 1, "AMBIGUOUS").when(F.col("relation").isin("calls", "inherits"), "INFERRED").otherwise(F.col("confidence"))
    resolved = found.select("source", F.col("candidate").alias("target"), "relation", label.alias("confidence"), "source_location", "target_ref")
    lost = rows.where("target_ref <> '' and size(any_) = 0")
    outside = lost.select("source", external_id(F.col("relation"), F.col("target_ref")).alias("target"), "relation", "confidence", "source_location", "target_ref")
    extra = outside.groupBy(F.col("target").alias("id")).agg(F.min("target_ref").alias("label"))
    extra = extra.select("id", "label", F.lit("external").alias("kind"), F.col("label").alias("qualname"), F.lit("").alias("source_file"), F.lit("external").alias("language"))
    weights = F.create_map(*(F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv))
    all_edges = direct.unionByName(resolved).unionByName(outside).withColumn("weight", weights[F.col("confidence")])
    all_edges = all_edges.withColumn("key", F.concat_ws(":", "relation", "source_location", "target")).dropDuplicates(["source", "target", "key"])
    return nodes.select(*extra.columns).unionByName(extra), all_edges
