"""Candidate merging, noisy-or fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import line_overlap, path_terms, query_terms_of, token_estimate
from siltstone.plans.stage import stage

#: How much a source's evidence counts.
SOURCE_WEIGHTS = {
    "bm25": 1.0, "symbol_search": 0.95, "semantic": 0.78, "call_graph": 0.86, "import_graph": 0.72, "inheritance_graph": 0.76,
    "graph_expansion": 0.62, "related_tests": 0.88, "git_history": 0.6, "hotspot": 0.42, "query_evolution": 0.7, "path": 0.65,
}
#: Fixed values of the reranker.
STRONGEST, AGREEMENT, EXACT, PER_PATH_TERM, MOST_PATH = 0.62, 0.28, 0.1, 0.04, 0.1
DELIBERATE_TEST, OTHER_TEST, PER_STEP, MOST_STEPS, MOST_COST = 0.08, 0.01, 0.035, 0.12, 0.09
OVERLAP_FROM, PER_OVERLAP, MOST_OVERLAP = 0.8, 0.14, 0.18

#: Columns of one retrieval signal; ``seq`` orders signals of one unit.
SIGNAL = "unit_id string, source string, score double, reason string, graph_distance int, edge_type string, exact boolean, seq long"


def signals(df: DataFrame, source: str, score: str, *, reason=None, seq: int = 0, graph_distance=None, edge_type=None, exact=None) -> DataFrame:
    """Rows of a retriever as signals of one source, scores clamped to 0..1."""
    return df.select(
        "unit_id", F.lit(source).alias("source"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))).alias("score"),
        (reason if reason is not None else F.lit("")).alias("reason"),
        (graph_distance if graph_distance is not None else F.lit(None)).cast("int").alias("graph_distance"),
        (edge_type if edge_type is not None else F.lit(None)).cast("string").alias("edge_type"),
        (exact if exact is not None else F.lit(False)).cast("boolean").alias("exact"), F.lit(seq).cast("long").alias("seq"),
    )


def merge(rows: DataFrame) -> DataFrame:
    """One candidate per unit: best score per source, sources and reasons in order of first appearance.

    ``(unit_id, source_scores map, retrieved_by, reasons, graph_distance, edge_type, exact)``;
    the distance is the least, the edge type that of the first signal with one.
    Empty reasons are left out.
    """
    best = rows.groupBy("unit_id", "source").agg(
        F.max("score").alias("score"), F.min("seq").alias("seq"), F.min("graph_distance").alias("graph_distance"),
        F.min(F.when(F.col("edge_type").isNotNull(), F.struct("seq", "edge_type"))).alias("edge"),
        F.max("exact").alias("exact"), F.sort_array(F.collect_set(F.struct("seq", "reason"))).alias("why"),
    )
    merged = best.groupBy("unit_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias("source_scores"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("retrieved_by"),
        F.sort_array(F.flatten(F.collect_list("why"))).alias("why"),
        F.min("graph_distance").alias("graph_distance"), F.min("edge").alias("edge"), F.max("exact").alias("exact"),
    )
    reasons = F.array_distinct(F.filter(F.transform("why", lambda x: x["reason"]), lambda r: r != ""))
    return merged.select("unit_id", "source_scores", "retrieved_by", reasons.alias("reasons"), "graph_distance", F.col("edge.edge_type").alias("edge_type"), "exact")


def weighted(source_scores):
    """Map column source -> weight x score."""
    table = F.create_map(*(F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv))
    return F.transform_values(source_scores, lambda k, v: F.coalesce(table[k], F.lit(0.0)) * v)


def noisy_or(values):
    """1 - product of (1 - min(0.95, value)) over an array; 0 for an empty one."""
    return F.lit(1.0) - F.aggregate(values, F.lit(1.0), lambda p, v: p * (F.lit(1.0) - F.least(F.lit(0.95), v)))


def rerank(candidates: DataFrame, units: DataFrame, task: str, *, redundancy: bool = True) -> DataFrame:
    """Candidates with units' columns, ``estimated_tokens``, ``score`` and ``rank`` (1 is best).

    Strongest evidence and agreement of sources, bonuses for exact symbols, path
    terms and tests, penalties for graph distance and size; then a range that a
    better-ranked one of the same file covers by 0.8 or more loses score.
    Order: score, fewer tokens, path, line, id.
    """
    terms = query_terms_of(task)
    one = units.join(candidates.select("unit_id"), "unit_id", "left_semi").dropDuplicates(["unit_id"]).drop("score")  # of the candidates only
    rows = candidates.join(one, "unit_id").withColumn("estimated_tokens", token_estimate(F.col("content")))
    w = F.map_values(weighted(F.col("source_scores")))
    hits = F.size(F.array_intersect(path_terms(F.col("path")), F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")))
    bonus = F.when(hits > 0, F.least(F.lit(MOST_PATH), hits * PER_PATH_TERM)).otherwise(0.0)
    test = F.when(F.col("node_type") == "test", F.when(F.array_contains("retrieved_by", "related_tests"), DELIBERATE_TEST).otherwise(OTHER_TEST)).otherwise(0.0)
    away = F.when(F.col("graph_distance").isNotNull(), F.least(F.lit(MOST_STEPS), F.col("graph_distance") * PER_STEP)).otherwise(0.0)
    cost = F.least(F.lit(MOST_COST), F.log1p("estimated_tokens") / 100.0)
    score = F.coalesce(F.array_max(w), F.lit(0.0)) * STRONGEST + noisy_or(w) * AGREEMENT + F.when(F.col("exact"), EXACT).otherwise(0.0) + bonus + test - away - cost
    rows = rows.withColumn("path_bonus", bonus).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    path_source = F.col("path_bonus") > 0
    rows = rows.withColumn("retrieved_by", F.when(path_source & ~F.array_contains("retrieved_by", "path"), F.array_append("retrieved_by", F.lit("path"))).otherwise(F.col("retrieved_by")))
    rows = rows.withColumn("source_scores", F.when(path_source, F.map_concat(F.map_filter("source_scores", lambda k, v: k != "path"), F.create_map(F.lit("path"), "path_bonus"))).otherwise(F.col("source_scores")))
    rows = stage(rows, "scored")  # a bounded list, read three times below
    if redundancy:
        rows = redundancy_penalty(rows)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 12)), "estimated_tokens", "path", "start_line", "unit_id")
    return rows.withColumn("rank", F.row_number().over(order))  # candidates of one task: bounded by the retrievers' limits


#: Lines of a bucket in which overlapping ranges meet.
BUCKET = 64


def redundancy_penalty(rows: DataFrame) -> DataFrame:
    """Lowers ``score`` of ranges that a better-ranked range of the same path covers.

    Needs unit_id, path, start_line, end_line, score, estimated_tokens.  Ranges
    meet in buckets of lines, each pair only in the bucket where the later one
    starts, so only ranges that do overlap make pairs, however long a file is.
    """
    # a range is in all its buckets as one that may hold another, and in its first one as one that starts there
    slim = rows.select("unit_id", "path", "start_line", "end_line", F.struct(-F.round("score", 12), "estimated_tokens", "path", "start_line", "unit_id").alias("key"))
    slim = slim.where("start_line <= end_line").withColumns({"from_": F.floor(F.col("start_line") / BUCKET), "to_": F.floor(F.col("end_line") / BUCKET)})
    a = slim.select("path", F.col("from_").alias("bucket"), *(F.col(c).alias(f"a_{c}") for c in ("unit_id", "start_line", "end_line", "key")))
    b = slim.select("path", F.explode(F.sequence("from_", "to_")).alias("bucket"), *(F.col(c).alias(f"b_{c}") for c in ("unit_id", "start_line", "end_line", "key")))
    # the one of ``a`` starts last (of equal starts, both orders would meet: then the larger id)
    met = a.join(b, ["path", "bucket"]).where("struct(b_start_line, b_unit_id) < struct(a_start_line, a_unit_id)")
    shared = line_overlap(F.col("a_start_line"), F.col("a_end_line"), F.col("b_start_line"), F.col("b_end_line"))
    worse = F.when(F.col("b_key") < F.col("a_key"), F.struct(F.col("a_unit_id").alias("unit_id"), (F.col("a_end_line") - F.col("a_start_line") + 1).alias("n"))).otherwise(
        F.struct(F.col("b_unit_id").alias("unit_id"), (F.col("b_end_line") - F.col("b_start_line") + 1).alias("n")))
    worst = met.select(worse.alias("w"), shared.alias("shared")).groupBy(F.col("w.unit_id").alias("unit_id")).agg(F.max(F.col("shared") / F.greatest(F.lit(1), F.col("w.n"))).alias("overlap"))
    out = rows.join(worst, "unit_id", "left").na.fill(0.0, ["overlap"])
    penalty = F.when(F.col("overlap") >= OVERLAP_FROM, F.least(F.lit(MOST_OVERLAP), F.col("overlap") * PER_OVERLAP)).otherwise(0.0)
    return out.withColumn("redundancy_penalty", penalty).withColumn("score", F.greatest(F.lit(0.0), F.col("score") - penalty))
