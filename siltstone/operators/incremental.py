"""Batch diffs and upserts of the file, unit, hint and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: characters of a parse error that are kept.
MOST_ERROR = 1000


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``(path, change)`` with change new, changed, unchanged or deleted.

    Unchanged: known with the same hash and without a parse error.
    """
    old = previous.select("path", F.col("content_hash").alias("old_hash"), "parse_error", F.lit(True).alias("known")).dropDuplicates(["path"])
    rows = current.select("path", "content_hash", F.lit(True).alias("here")).dropDuplicates(["path"]).join(old, "path", "full")
    same = (F.col("old_hash") == F.col("content_hash")) & F.col("parse_error").isNull()
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return rows.select("path", change.alias("change"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_files(table: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The table with all rows of the new rows' files replaced by them."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def drop_files(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def record_errors(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files with new rows (path, content_hash, mtime_ns, size_bytes, indexed_at, parse_error) upserted; units stay as they were."""
    cut = errors.withColumn("parse_error", F.substring("parse_error", 1, MOST_ERROR))
    return replace_files(files, cut.select(*[c if c in cut.columns else F.lit(None).alias(c) for c in files.columns]))


def drop_stale_vectors(vectors: DataFrame, units: DataFrame) -> DataFrame:
    """Vectors of units that still exist."""
    return vectors.join(units.select("unit_id"), "unit_id", "left_semi")


def apply_parse(state: dict[str, DataFrame], parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New state of files, units, hints and vectors after (re)parsing some files.

    Keys of both: files, units, hints; the state also has vectors.  Rows of the
    parsed files are replaced, hints of their old units go, vectors of vanished units go.
    """
    old_units = state["units"].join(parsed["files"].select("path"), "path", "left_semi").select(F.col("unit_id").alias("source_id"))
    units = replace_files(state["units"], parsed["units"])
    hints = state["hints"].join(old_units.distinct(), "source_id", "left_anti").unionByName(parsed["hints"])
    return {"files": replace_files(state["files"], parsed["files"]), "units": units, "hints": hints, "vectors": drop_stale_vectors(state["vectors"], units)}


def status(**tables: DataFrame) -> DataFrame:
    """``(table, n)`` row counts of the given tables."""
    out = None
    for name, t in tables.items():
        part = t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def failures(files: DataFrame) -> DataFrame:
    """``(path, parse_error)`` of files with an error, by path."""
    return files.where("parse_error is not null").select("path", "parse_error").orderBy("path")
