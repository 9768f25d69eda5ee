"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.stage import stage

#: Repeated ids up to which their list is broadcast; beyond, it is joined by a shuffle.
MOST_REPEATED = 500_000

_SPANS = "array<struct<begin:int,end:int,first_line:int,last_line:int>>"
_BREAK = re.compile(r"\n(?:[ \t]*\n)*")


def _boundary(text: str, a: int, b: int) -> int:
    """The strongest cut near the middle of ``text[a:b]``.

    Strength in the middle half: blank line before unindented text, blank line,
    unindented line, other line; then a line end anywhere in the part; then, in
    the middle half, white space, any character.  Among the strongest the
    nearest to the middle; of two equally near the left one.
    """
    lo, hi, mid = a + (b - a) // 4, b - (b - a) // 4, (a + b) // 2
    best = (0, 0, 0)
    for m in _BREAK.finditer(text, lo, hi):
        at = m.end()
        if at >= hi:
            break
        after = text[at]
        flush = after not in " \t\r\n)]}"
        blank = m.end() - m.start() > 1 or text[m.start() - 2 : m.start()] in ("\n\r", "\r\n")
        rank = (2 * blank + flush + 1, -abs(at - mid), -at)
        if not best[0] or rank > best:
            best = rank
    if best[0]:
        return -best[2]
    left, right = text.rfind("\n", a, mid), text.find("\n", mid, b - 1)
    options = [x + 1 for x in (left, right) if x >= 0]
    if options:
        return min(options, key=lambda x: (abs(x - mid), x))
    left, right = text.rfind(" ", lo, mid), text.find(" ", mid, hi)
    options = [x + 1 for x in (left, right) if x >= 0]
    if options:
        return min(options, key=lambda x: (abs(x - mid), x))
    if text[mid - 1] == "\r" and text[mid] == "\n":
        return mid + 1
    return mid


def bisect(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover ``text``; each starts ``overlap`` before its cut.

    The text is halved at its strongest boundary near the middle while a part
    exceeds ``limit - overlap``; then each part but the first is extended to the left.
    """
    if limit <= 2 * overlap + 4 or overlap < 0:
        raise ValueError("limit must exceed twice the overlap")
    if len(text) <= limit:
        return [(0, len(text))]
    parts, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            parts.append((a, b))
            continue
        cut = _boundary(text, a, b)
        todo.append((cut, b))
        todo.append((a, cut))
    return [(max(0, a - overlap), b) for a, b in parts]


def split_spans(content, limit: int = 4000, overlap: int = 200):
    """Column of the pieces' spans: code-point offsets and 0-based first and last line."""
    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            got, at, line = [], 0, 0
            for a, b in bisect(text, limit, overlap):
                line += text.count("\n", at, a)
                at = a
                got.append({"begin": a, "end": b, "first_line": line, "last_line": line + text.count("\n", a, b - 1)})
            out.append(got)
        return pd.Series(out)

    return spans.asNondeterministic()(content)  # so that no filter on the spans evaluates it again


def without_repeats(rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows, shuffling only those whose ``key`` occurs more than once.

    A pass over the keys alone finds the repeated ones; rows of the others go
    through where they are.  The list of repeated keys is broadcast only if it
    is short (:data:`MOST_REPEATED`), else joined by a shuffle.
    """
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(key)
    again = stage(again, "repeated")
    n = again.count()
    if not n:
        return rows
    repeated = F.broadcast(again) if n <= MOST_REPEATED else again
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").distinct())


def split_oversized(units: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(unit_id, piece, pieces, start_line, end_line, begin, end, text)`` of texts above ``limit``.

    Only texts of more than ``limit`` code points are cut (others need no
    piece); null contents and ids are left out, repeated rows count once, and
    of differing contents of one id the pieces of each come out.  Every piece
    has at most ``limit`` characters, consecutive ones share exactly
    ``overlap``, and without overlaps they join to the text.  ``start_line``
    and ``end_line`` count from the unit's own start_line (1 where null).
    Python sees the long texts only and returns offsets; the texts are cut
    natively.  Repeated rows go before the cut, and no text is shuffled but
    those of ids that occur more than once.
    """
    rows = units.select("unit_id", "start_line", "content").where(f"unit_id is not null and length(content) > {int(limit)}")
    rows = without_repeats(rows, "unit_id")
    rows = rows.withColumn("spans", split_spans(F.col("content"), limit, overlap))
    first = F.coalesce("start_line", F.lit(1))
    out = rows.select(
        "unit_id", F.size("spans").alias("pieces"), first.alias("first"), "content", F.posexplode("spans").alias("piece", "s")
    )
    return out.select(
        "unit_id",
        (F.col("piece") + 1).alias("piece"),
        "pieces",
        (F.col("first") + F.col("s.first_line")).alias("start_line"),
        (F.col("first") + F.col("s.last_line")).alias("end_line"),
        F.col("s.begin").alias("begin"),
        F.col("s.end").alias("end"),
        F.substring(F.col("content"), F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin")).alias("text"),
    )
