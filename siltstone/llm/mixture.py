"""Mixing sources to target weights: Pfair block schedule over distributed prefix sums."""

from __future__ import annotations

import base64
import heapq
import os
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.stage import stage

#: Vocabulary file of a public tokenizer, readable on every executor.
TOKENIZER = os.environ.get("SILTSTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks of the schedule (each total / BLOCKS tokens), and groups of a source's prefix sum.
BLOCKS, GROUPS = 4096, 4096
#: Least tokens of a block, so that documents are small against it.
LEAST_BLOCK = 8192
#: A target table beyond so many sources is refused: the schedule is made on the driver.
MAX_SOURCES = 10_000


def token_counter(path: str):
    """Texts -> token counts, by the kind of vocabulary file (.tiktoken, .json, .model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(e.encode_ordinary(x)) for x in texts]


def normal_source(column):
    """Lower case, one underscore for each run of other characters, none at the ends; null if nothing is left."""
    plain = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(plain, r"^_+|_+$", ""), F.lit(""))


def document_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every text, whole; null and empty texts and null ids are left out.

    Repeated rows of an id count once (the largest count, the smallest source).
    """
    kind = dict(documents.dtypes)["doc_id"]

    def count(batches):
        import pyarrow as pa

        counter = token_counter(tokenizer)
        for b in batches:
            n = counter(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    rows = documents.select("doc_id", normal_source(F.col("source")).alias("source"), "text").where("doc_id is not null and text is not null")
    rows = rows.mapInArrow(count, f"doc_id {kind}, source string, n_tokens long").where("n_tokens > 0")
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def pfair(weights: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int]]:
    """Slots in order, each the ``(source, block)`` it runs.

    Block j (from 0) of a source of weight w is released at floor(j / w) and due
    at ceil((j + 1) / w).  In each slot the released block of the earliest
    deadline runs; ties go to the larger weight, then the smaller name.  With
    weights summing to 1 every block meets its window, so after any number of
    slots each source is within one block of its exact share.
    """
    def window(s, j):
        w = weights[s]
        return (j * w.denominator) // w.numerator, -(-(j + 1) * w.denominator // w.numerator)

    waiting, ready, out, t = [], [], [], 0
    for s, n in blocks.items():
        if n:
            heapq.heappush(waiting, (0, s, 0))
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], -weights[s], s, j))
        if ready:
            _, _, s, j = heapq.heappop(ready)
            out.append((s, j))
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, (window(s, j + 1)[0], s, j + 1))
            t += 1
        else:
            t = waiting[0][0]
    return out


def _plan(have: dict[str, int], targets: list, total: int | None, blocks: int):
    """Per source its tokens wanted; the block size; the schedule."""
    goal = {}
    for r in targets:
        share = Fraction(r.target_share).limit_denominator(10**9) if r.target_share and r.target_share > 0 else Fraction(0)
        if r.source is not None and share and have.get(r.source) and (r.max_repeats or 0) > 0:
            if r.source in goal:
                raise ValueError(f"two targets for source {r.source!r}")
            goal[r.source] = (share, int(r.max_repeats))
    whole = sum(s for s, _ in goal.values())
    if not whole:
        return {}, 1, []
    weights = {k: s / whole for k, (s, _) in goal.items()}
    most = min(Fraction(have[k] * goal[k][1]) / w for k, w in weights.items())
    size = min(most, Fraction(total)) if total is not None else most
    need = {k: int(size * w) for k, w in weights.items()}
    block = max(LEAST_BLOCK, int(size) // blocks)
    return need, block, pfair(weights, {k: -(-n // block) for k, n in need.items()})


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, tokenizer: str = TOKENIZER,
        blocks: int = BLOCKS, groups: int = GROUPS, tokens: DataFrame | None = None) -> DataFrame:
    """``(slot, position, doc_id, copy, source, n_tokens)``: the mixture, in order of (slot, position).

    The size is the largest at which every source has its share without using a
    document more than ``max_repeats`` times (or ``total`` tokens, if less).
    Each source is laid out in hash order, again and again up to its cap; a
    document copy is in if its middle lies before the source's needed tokens.  So a
    source misses its share by at most half a document, and the interleaving
    (a document goes with the block it begins in) by less than a block of
    max(LEAST_BLOCK, total / ``blocks``) tokens and a document.

    The layout is a prefix sum in two steps (sums of ``groups`` hash ranges,
    then running sums within each), so no task holds a whole source.  Only
    per-range and per-source sums, and the schedule of about ``blocks`` rows, are
    small tables.  Targets of sources without tokens are left out and the
    others' shares scaled up; documents without a target source take no part.
    """
    counted = tokens if tokens is not None else stage(document_tokens(documents, tokenizer), "tokens")
    spark = counted.sparkSession
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").distinct().limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = sorted({r.source for r in wanted if r.source is not None})
    used = counted.where(F.col("source").isin(names)) if names else counted.where("false")
    have = {r.source: r.n for r in used.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    need, block, schedule = _plan(have, wanted, total, blocks)
    plan = spark.createDataFrame([(s, have[s], n) for s, n in need.items()], "source string, have long, need long")
    slots = spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(schedule)], "source string, block long, slot long")

    keyed = used.withColumn("key", F.xxhash64("doc_id")).withColumn("range", F.pmod(F.shiftright("key", 20), F.lit(groups)))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most GROUPS rows per source
    sums = sums.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    laid = laid.join(sums, ["source", "range"]).join(F.broadcast(plan), "source")
    start = F.col("offset") + F.col("inner")
    passes = F.ceil((F.col("need") - start - F.col("n_tokens") / 2) / F.col("have"))  # copies whose middle lies before the need
    laid = laid.withColumn("start", start).where(passes > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), passes.cast("long") - 1)))
    placed = laid.select("doc_id", "copy", "source", "n_tokens", (F.col("start") + F.col("copy") * F.col("have")).alias("position"))
    placed = placed.withColumn("block", F.floor(F.col("position") / block))
    return placed.join(F.broadcast(slots), ["source", "block"]).select("slot", "position", "doc_id", "copy", "source", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, **options) -> DataFrame:
    """Per target source: target and actual share, tokens, uses and the most uses of one document."""
    counted = stage(document_tokens(documents, tokenizer), "tokens")
    mixed = mix(documents, targets, tokens=counted, **options)
    each = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    held = counted.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    out = wanted.join(held, "source", "left").join(each, "source", "left").na.fill(0, ["available", "tokens", "uses", "most_uses"])
    whole = Window.partitionBy(F.lit(0))  # a row per target source
    return out.withColumn("actual_share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(whole), F.lit(1)), 6))
