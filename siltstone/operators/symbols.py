"""Symbol-name search: exact, suffix, substring and fuzzy matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.fuzzy import best_ratio_udf
from siltstone.functions.text import query_terms_of

#: Searched unit types, scores of the rungs, least score.
TYPES = ("class", "function", "method", "test")
WHOLE, NAME, SUFFIX, IN_NAME, IN_QUALNAME, FUZZY = 1.0, 0.98, 0.94, 0.82, 0.68, 0.72
LEAST = 0.35


def ladder(name: Column, qualname: Column, query: str, *, fuzzy: bool = True) -> Column:
    """Score 0..1 of a symbol for a query: the best rung over its terms."""
    n, q, whole = F.lower(name), F.lower(qualname), query.strip().lower()
    terms = query_terms_of(query)
    rungs = [F.lit(0.0)]
    for t in terms:
        rungs.append(
            F.when(n == t, NAME).when(q.endswith("." + t), SUFFIX).when(n.contains(t), IN_NAME).when(q.contains(t), IN_QUALNAME).otherwise(0.0)
        )
    best = F.greatest(*rungs) if len(rungs) > 1 else rungs[0]
    if fuzzy and terms:  # a term on a native rung beats its own ratio, which is at most FUZZY, unless the rung is IN_QUALNAME
        best = F.greatest(best, best_ratio_udf(terms)(n) * FUZZY)
    return F.when((q == whole) | (n == whole) | q.endswith("." + whole), WHOLE).otherwise(best)


def search(units: DataFrame, query: str, *, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """``(unit_id, path, start_line, name, score, exact)`` of the best symbols; ties by path, line, id.

    A query without terms finds nothing.  With ``fuzzy`` the last rung is the
    best Ratcliff-Obershelp ratio against a term, in Arrow batches and memoised
    per distinct name; the other rungs are native.
    """
    rows = units.where(F.col("node_type").isin(*TYPES)).select("unit_id", "path", "start_line", "name", "qualname").dropDuplicates(["unit_id"])
    terms = query_terms_of(query)
    if not terms:
        return rows.select("unit_id", "path", "start_line", "name", F.lit(0.0).alias("score"), F.lit(False).alias("exact")).where("false")
    n, q = F.lower("name"), F.lower("qualname")
    exact = F.lit(False)
    for t in terms:
        exact = exact | (n == t) | q.endswith("." + t)
    scored = rows.select("unit_id", "path", "start_line", "name", ladder(F.col("name"), F.col("qualname"), query, fuzzy=fuzzy).alias("score"), exact.alias("exact"))
    return scored.where(F.col("score") >= LEAST).orderBy(F.desc("score"), "path", "start_line", "unit_id").limit(limit)
