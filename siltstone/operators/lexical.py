"""Field-weighted BM25 search: by a scan, or over a postings table with positions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltstone.functions.fuzzy import porter_stem
from siltstone.functions.text import query_terms_of
from siltstone.plans.stage import stage

#: Fields of source units and of commits with their weights, and the constants of the formula.
UNIT_FIELDS = {"path": 3.0, "name": 6.0, "qualname": 5.0, "signature": 3.0, "docstring": 2.5, "content": 1.0}
COMMIT_FIELDS = {"message": 3.0, "summary": 1.5, "paths": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-cased runs of letters and digits (``_`` separates), optionally stemmed."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return _stem_udf()(found) if stem else found


def _stem_udf():
    memo: dict[str, str] = {}

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        out = []
        for words in lists:
            for w in words:
                if w not in memo:
                    if len(memo) > 500_000:
                        memo.clear()
                    memo[w] = porter_stem(w)
            out.append([memo.get(w) or porter_stem(w) for w in words])
        return pd.Series(out)

    return stems.asNondeterministic()  # so that no plan evaluates it twice


def phrases(query: str, stem: bool = False, limit: int = 24) -> list[list[str]]:
    """Each query term as the token phrase it stands for (``join_path`` is ``join path``)."""
    out = [[w for w in re.split(r"[^\w]+|_+", t) if w] for t in query_terms_of(query, limit)]
    return [[porter_stem(w) for w in p] if stem else p for p in out if p]


def _occurrences(line: Column, phrase: list[str]) -> Column:
    """Times a phrase stands in a line of tokens each between single spaces (`` a  b ``)."""
    needle = "".join(f" {w} " for w in phrase)
    return (F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / len(needle)


def bm25_scan(docs: DataFrame, key: str, fields: dict[str, float], query: str, *, stem: bool = False, keep: tuple = ()) -> DataFrame:
    """``(key, bm25)`` of all documents that match any query term, by one scan; ``keep`` names columns that come along.

    Term statistics are those of the whole table: the pass that finds and writes
    the matching documents' counts observes document frequencies and lengths on
    the way, so the text is read once and neither it nor its tokens are shuffled
    (rows of one key, which count once, are told apart by their counts).  A null field is
    empty.  No match or no term: no rows.
    """
    wanted = phrases(query, stem)
    if not wanted:
        return docs.select(key, *keep, F.lit(0.0).alias("bm25")).where("false")
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    parsed = docs.select(key, *kept, *(tokens(F.col(f), stem).alias(f) for f in fields))
    size = sum(F.size(f) for f in fields)
    lined = parsed.select(key, *(f"keep_{c}" for c in keep), size.alias("d"), *(F.concat_ws("", F.transform(f, lambda t: F.concat(F.lit(" "), t, F.lit(" ")))).alias(f) for f in fields))
    names = [f"f{i}" for i in range(len(wanted))]
    hits = lined.select(key, *(f"keep_{c}" for c in keep), "d", *(sum(_occurrences(F.col(f), p) * w for f, w in fields.items()).alias(n) for n, p in zip(names, wanted)))
    seen = Observation()
    hits = hits.dropDuplicates([key]).observe(seen, F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("d"), F.lit(0)).alias("size"), *(F.count(F.when(F.col(n) > 0, 1)).alias("n_" + n) for n in names))
    found = stage(hits.where(" or ".join(f"{n} > 0" for n in names)), "hits")
    stats = seen.get
    n_docs, avgdl = stats["n_docs"], stats["size"] / max(1, stats["n_docs"])
    total = F.lit(0.0)
    for n in names:
        idf = max(math.log((n_docs - stats["n_" + n] + 0.5) / (stats["n_" + n] + 0.5)), LEAST_IDF)
        total = total + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("d") / max(avgdl, 1e-9)))
    return found.select(key, *(F.col(f"keep_{c}").alias(c) for c in keep), total.alias("bm25"))


def search(units: DataFrame, query: str, *, limit: int = 30, stem: bool = True) -> DataFrame:
    """Top units by BM25 but modules: ``(unit_id, path, start_line, bm25, score, matched_terms)``.

    ``score`` is relative to the best; ties by path, line and id.  Corpus
    statistics include modules.  Repeated rows of one id count once.
    """
    hits = bm25_scan(units, "unit_id", UNIT_FIELDS, query, stem=stem, keep=("path", "start_line", "node_type"))
    terms = query_terms_of(query)
    top = hits.where("node_type <> 'module'").select("unit_id", "path", "start_line", "bm25").orderBy(F.desc(F.round("bm25", 9)), "path", "start_line", "unit_id").limit(limit)
    top = stage(top, "top")  # at most limit rows: texts are fetched for these only
    text = F.lower(F.concat_ws(" ", "path", "qualname", "signature", "docstring", "content"))
    matched = F.filter(F.array(*(F.when(text.contains(t), F.lit(t)) for t in terms)) if terms else F.array().cast("array<string>"), lambda x: x.isNotNull())
    said = units.join(F.broadcast(top.select("unit_id")), "unit_id", "left_semi").select("unit_id", matched.alias("matched_terms")).dropDuplicates(["unit_id"])
    best = Window.partitionBy(F.lit(0))  # at most limit rows
    return top.join(said, "unit_id").withColumn("score", F.col("bm25") / F.max("bm25").over(best)).orderBy(F.desc(F.round("bm25", 9)), "path", "start_line", "unit_id")


def build_postings(docs: DataFrame, key: str, fields: dict[str, float], *, stem: bool = False) -> DataFrame:
    """``(term, doc, field, pos)``: an inverted index with positions, written in ranges of terms.

    Documents are tokenised once.  The table is sorted by term, so a later
    look-up of a term reads only the row groups whose range has it.
    """
    each = [F.struct(F.lit(f).alias("field"), tokens(F.col(f), stem).alias("words")) for f in fields]
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.array(*each)).alias("f")).select("doc", "f.field", F.posexplode("f.words").alias("pos", "term"))
    return stage(rows.select("term", "doc", "field", "pos").repartitionByRange("term").sortWithinPartitions("term", "doc"), "postings")


def bm25_postings(postings: DataFrame, fields: dict[str, float], query: str, *, stem: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """``(doc, bm25)`` from a postings table; ``docs`` (column ``doc``) adds documents without tokens to the statistics.

    Reads the postings of the query's terms only, but for the corpus lengths.
    Phrases join their terms' postings on document, field and shifted position.
    """
    wanted = phrases(query, stem)
    if not wanted:
        return postings.select("doc", F.lit(0.0).alias("bm25")).where("false")
    lengths = postings.groupBy("doc").agg(F.count(F.lit(1)).alias("d"))
    if docs is not None:
        lengths = docs.select("doc").distinct().join(lengths, "doc", "left").na.fill(0, ["d"])
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("d").alias("avgdl"))
    weight = F.lit(0.0)
    for f, w in fields.items():
        weight = F.when(F.col("field") == f, F.lit(w)).otherwise(weight)
    each = None
    for i, p in enumerate(wanted):
        found = postings.where(F.col("term") == p[0]).select("doc", "field", "pos")
        for step, w in enumerate(p[1:], 1):
            nxt = postings.where(F.col("term") == w).select("doc", "field", (F.col("pos") - step).alias("pos"))
            found = found.join(nxt, ["doc", "field", "pos"])
        found = found.groupBy("doc").agg(F.sum(weight).alias("f")).withColumn("phrase", F.lit(i))
        each = found if each is None else each.unionByName(found)
    n = each.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    rows = each.join(F.broadcast(n), "phrase").join(lengths, "doc").crossJoin(F.broadcast(stats))  # a row per phrase, one of statistics
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avgdl")))
    return rows.groupBy("doc").agg(F.sum(part).alias("bm25"))
