"""Selection of whole ranges under a token budget, one group per task."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, render_cost

#: Fixed values of the marginal utility.
NEW_SOURCE, NEW_FILE, FIRST_TEST, DIRECT, REDUNDANT, LEAST = 0.035, 0.055, 0.11, 0.03, 0.3, 0.02

_DECISION = "task_id string, unit_id string, selected boolean, place int, cost int, utility double, reason string"


def _choose(rows: list[dict], budget: int) -> list[dict]:
    """Greedy by utility per root of cost; each round looks at what still fits."""
    left, taken, used = list(rows), [], 0
    sources: set = set()
    files: set = set()
    tested = False
    for r in left:
        r["terms"], r["retrieved_by"], r["redundancy"] = set(r["terms"]), set(r["retrieved_by"]), 0.0

    def utility(r):
        gain = NEW_SOURCE * len(r["retrieved_by"] - sources) + NEW_FILE * (r["path"] not in files)
        gain += FIRST_TEST * (r["node_type"] == "test" and not tested) + DIRECT * (r["graph_distance"] == 1)
        return max(0.0, r["score"] + gain - REDUNDANT * r["redundancy"])

    while left:
        fits = [r for r in left if used + r["cost"] <= budget]
        if not fits:
            break
        for r in fits:
            r["utility"] = utility(r)
        best = min(fits, key=lambda r: (-r["utility"] / math.sqrt(max(1, r["cost"])), -r["utility"], r["path"], r["start_line"], r["unit_id"]))
        if best["utility"] <= LEAST:
            break
        left.remove(best)
        used += best["cost"]
        best.update(selected=True, place=len(taken) + 1, reason="chosen for relevance" + (", new evidence" if best["retrieved_by"] - sources else ""))
        taken.append(best)
        sources |= best["retrieved_by"]
        files.add(best["path"])
        tested = tested or best["node_type"] == "test"
        for r in left:  # redundancy only grows, so it is kept up by the newest choice
            overlap = 0.0
            if r["path"] == best["path"]:
                shared = min(r["end_line"], best["end_line"]) - max(r["start_line"], best["start_line"]) + 1
                overlap = max(0, shared) / max(1, r["end_line"] - r["start_line"] + 1)
            union = len(r["terms"] | best["terms"])
            same = len(r["terms"] & best["terms"]) / union if union else 0.0
            r["redundancy"] = max(r["redundancy"], overlap, same)
    for r in left:
        r["utility"] = utility(r)
        if used + r["cost"] > budget:
            why = f"{r['cost']} tokens do not fit the {budget - used} left"
        elif r["redundancy"] > 0.4:
            why = f"{r['redundancy']:.0%} of its evidence is there already"
        else:
            why = "lower marginal relevance"
        r.update(selected=False, place=None, reason=why)
    return rows


def select(candidates: DataFrame, budget: int) -> DataFrame:
    """``(task_id, unit_id, selected, place, cost, utility, reason)`` for every candidate.

    Candidates need task_id, unit_id, path, node_type, start_line, end_line,
    score, retrieved_by, graph_distance, content, and qualname, reasons,
    language for the cost of rendering.  The greedy choice is sequential, so a
    task is one group; its candidates are bounded by the retrievers' limits.
    The chosen costs never sum to more than ``budget``; no budget, no choice.
    """
    cost = render_cost(*(F.col(c) for c in ("qualname", "path", "start_line", "end_line", "score", "retrieved_by", "reasons", "language", "content")))
    rows = candidates.select("task_id", "unit_id", "path", "node_type", "start_line", "end_line", "score", "retrieved_by",
                             F.coalesce("graph_distance", F.lit(-1)).alias("graph_distance"), query_terms(F.col("content"), 100).alias("terms"), cost.alias("cost"))

    def choose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = _choose(pdf.to_dict("records"), budget)
        return pd.DataFrame({
            "task_id": key[0], "unit_id": [r["unit_id"] for r in got], "selected": [r["selected"] for r in got],
            "place": pd.array([r["place"] for r in got], "Int32"), "cost": [r["cost"] for r in got],
            "utility": [r["utility"] for r in got], "reason": [r["reason"] for r in got],
        })

    return rows.groupBy("task_id").applyInPandas(choose, _DECISION)


def first_fit(rows: DataFrame, budget: int, *, group: str, order: list[str], cost: str) -> DataFrame:
    """Rows of each group that fit when taken in order; one that doesn't fit is skipped, later ones may still fit."""
    schema = rows.schema

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        used, keep = 0, []
        for c in pdf[cost]:
            ok = used + c <= budget
            used += c if ok else 0
            keep.append(ok)
        return pdf[keep]

    return rows.groupBy(group).applyInPandas(fit, schema)
