"""Retrieval metrics per task, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EMPTY = "array<string>"


def metrics(tasks: DataFrame, items: DataFrame, top_k: int, corpus_tokens: DataFrame | None = None) -> DataFrame:
    """One row of metrics per task.

    ``tasks``: task_id, gold_files, gold_symbols, gold_line_ranges.  ``items``:
    task_id, rank, file, symbol, start_line, end_line, estimated_tokens, sources.
    ``corpus_tokens``: task_id, repository_source_tokens.  Ranking metrics look at the
    first ``top_k`` items, costs at all; repeated files and symbols count at
    their first place.  A task without items scores 0.
    """
    limited = items.where(F.col("rank") <= top_k)
    gold = tasks.select("task_id", F.array_distinct(F.coalesce("gold_files", F.array().cast(_EMPTY))).alias("gf"), F.array_distinct(F.coalesce("gold_symbols", F.array().cast(_EMPTY))).alias("gs"))

    def firsts(rows, column, name):
        first = rows.groupBy("task_id", column).agg(F.min("rank").alias("r"))
        return first.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", column))), lambda x: x[column]).alias(name))

    ranked, symbols, package = firsts(limited, "file", "rf"), firsts(limited, "symbol", "rs"), firsts(items, "file", "pf")
    sums = items.groupBy("task_id").agg(F.sum("estimated_tokens").alias("context_tokens"), F.count(F.lit(1)).alias("selected_item_count"))
    in_top = limited.groupBy("task_id").agg(F.collect_list("file").alias("tf"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("src"))
    rows = gold
    for other in (ranked, symbols, package, sums, in_top, line_coverage(tasks, limited)):
        rows = rows.join(other, "task_id", "left")
    rows = rows.join(corpus_tokens, "task_id", "left") if corpus_tokens is not None else rows.withColumn("repository_source_tokens", F.lit(0).cast("long"))
    for c in ("rf", "rs", "pf", "tf", "src"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(_EMPTY)))
    rows = rows.na.fill(0, ["context_tokens", "selected_item_count", "repository_source_tokens"]).na.fill(0.0, ["gold_line_coverage"])
    n_gf, n_gs = F.size("gf"), F.size("gs")
    rel, prel, srel = (F.size(F.array_intersect(a, b)) for a, b in (("gf", "rf"), ("gf", "pf"), ("gs", "rs")))
    at = F.filter(F.transform("rf", lambda x, i: F.when(F.array_contains("gf", x), i + 1)), lambda i: i.isNotNull())
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    ideal = gain(F.when(n_gf > 0, F.sequence(F.lit(1), F.least(F.lit(top_k), n_gf))).otherwise(F.array().cast("array<int>")))
    one = F.lit(1)
    saved = F.col("repository_source_tokens") - F.col("context_tokens")
    return rows.select(
        "task_id",
        (rel / F.greatest(one, n_gf)).alias("file_recall_at_k"),
        (rel / F.lit(max(1, top_k))).alias("file_precision_at_k"),
        (rel > 0).cast("double").alias("file_hit_at_k"),
        ((n_gf > 0) & (rel == n_gf)).cast("double").alias("complete_file_recall_at_k"),
        (prel / F.greatest(one, n_gf)).alias("package_file_recall"),
        (prel / F.greatest(one, F.size("pf"))).alias("package_file_precision"),
        (prel > 0).cast("double").alias("package_file_hit"),
        ((n_gf > 0) & (prel == n_gf)).cast("double").alias("package_complete_file_recall"),
        (srel / F.greatest(one, n_gs)).alias("symbol_recall_at_k"),
        F.when(n_gs > 0, srel / F.lit(max(1, top_k))).otherwise(0.0).alias("symbol_precision_at_k"),
        F.coalesce(F.lit(1.0) / F.try_element_at(at, F.lit(1)), F.lit(0.0)).alias("mrr"),
        F.when(ideal > 0, gain(at) / ideal).otherwise(0.0).alias("ndcg_at_k"),
        "gold_line_coverage", "context_tokens", "repository_source_tokens", saved.alias("tokens_saved"),
        F.when(F.col("repository_source_tokens") > 0, saved / F.col("repository_source_tokens")).otherwise(0.0).alias("token_reduction_fraction"),
        "selected_item_count", F.size("pf").alias("selected_file_count"),
        (F.col("context_tokens") / F.greatest(one, rel)).alias("tokens_per_relevant_file"),
        F.size("src").alias("evidence_source_diversity"),
        (F.size(F.filter("tf", lambda x: F.array_contains("gf", x))) / F.greatest(one, F.size("tf"))).alias("selected_context_relevance"),
    )


def line_coverage(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """``(task_id, gold_line_coverage)``: share of the gold ranges' lines that items of their files hold, each line of a range once.

    Covered ranges are merged per gold range by a running maximum of their
    ends, so no line is exploded, however long a range is.
    """
    gold = tasks.select("task_id", F.posexplode("gold_line_ranges").alias("g", "r")).select("task_id", "g", F.col("r.file").alias("file"), F.col("r.start_line").alias("gs"), F.col("r.end_line").alias("ge"))
    total = gold.groupBy("task_id").agg(F.sum(F.col("ge") - F.col("gs") + 1).alias("total"))
    hit = gold.join(items.select("task_id", "file", "start_line", "end_line"), ["task_id", "file"])
    hit = hit.select("task_id", "g", F.greatest("gs", "start_line").alias("s"), F.least("ge", "end_line").alias("e")).where("s <= e")
    before = Window.partitionBy("task_id", "g").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("e").over(before)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(seen + 1, F.col("s"))) + 1)
    covered = hit.withColumn("new", new).groupBy("task_id").agg(F.sum("new").alias("covered"))
    return total.join(covered, "task_id", "left").select("task_id", F.when(F.col("total") > 0, F.coalesce("covered", F.lit(0)) / F.col("total")).otherwise(0.0).alias("gold_line_coverage"))


#: Metrics that are counts: their means are rounded half to even.
COUNTS = ("context_tokens", "repository_source_tokens", "tokens_saved", "selected_item_count", "selected_file_count", "evidence_source_diversity")


def mean_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Means of all metrics by configuration (or whatever the groups are)."""
    skip = {*by, "task_id"}
    parts = [F.bround(F.avg(c)).cast("long").alias(c) if c in COUNTS else F.avg(c).alias(c) for c in rows.columns if c not in skip]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), *parts)


def filename_baseline(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(task_id, file, score, rank)``: files ranked by the number of the task's terms among their path's terms."""
    from siltstone.functions.text import path_terms, query_terms

    words = files.select(F.col("path").alias("file"), F.explode(path_terms(F.col("path"))).alias("term"))
    wanted = tasks.select("task_id", F.explode(query_terms(F.col("task"))).alias("term"))
    score = words.join(wanted, "term").groupBy("task_id", "file").agg(F.count(F.lit(1)).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "file")))
