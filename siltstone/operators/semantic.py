"""Embedding cache and exact cosine search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hashing import HashEmbedder, hash_embedding_udf
from siltstone.functions.text import cosine

#: Fixed value: unit types that are embedded.
TYPES = ("file", "class", "function", "method", "test")


def embedding_text(units: DataFrame):
    """The text that stands for a unit: its non-empty fields on lines of their own."""
    return F.array_join(F.filter(F.array("path", "qualname", "signature", "docstring", "content"), lambda x: x.isNotNull() & (x != "")), "\n")


def pending(units: DataFrame, cached: DataFrame, provider: str) -> DataFrame:
    """Units whose cached vector of the provider is missing or of another content hash."""
    held = cached.where(F.col("provider") == provider).select("unit_id", F.col("content_hash").alias("held"))
    rows = units.where(F.col("node_type").isin(*TYPES)).join(held, "unit_id", "left")
    return rows.where(~F.col("held").eqNullSafe(F.col("content_hash"))).drop("held")


def embed_units(units: DataFrame, provider: str = "local-hash-v1", dimensions: int = 384) -> DataFrame:
    """``(unit_id, provider, content_hash, dimensions, vector)`` by the hash embedder, in Arrow batches."""
    return units.select("unit_id", F.lit(provider).alias("provider"), "content_hash", F.lit(dimensions).alias("dimensions"),
                        hash_embedding_udf(dimensions)(embedding_text(units)).alias("vector"))


def refresh(cached: DataFrame, units: DataFrame, provider: str = "local-hash-v1", dimensions: int = 384) -> DataFrame:
    """The cache with pending units embedded anew and vectors of vanished units dropped."""
    todo = pending(units, cached, provider)
    fresh = embed_units(todo, provider, dimensions)
    kept = cached.join(units.select("unit_id"), "unit_id", "left_semi").join(fresh.select("unit_id", "provider"), ["unit_id", "provider"], "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def fresh(vectors: DataFrame, units: DataFrame) -> DataFrame:
    """Vectors whose content hash is that of the unit as it is now."""
    return vectors.join(units.select("unit_id", "content_hash").distinct(), ["unit_id", "content_hash"])


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "unit_id", vector: str = "vector") -> DataFrame:
    """``(key, similarity)`` of the ``k`` nearest by exact cosine, ties by key; only positive ones.

    The query is one literal array; scoring is native and only ``k`` rows per task leave it.
    """
    literal = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.select(key, F.round(cosine(F.col(vector), literal), 9).alias("similarity")).where("similarity is not null and not isnan(similarity)")
    return rows.orderBy(F.desc("similarity"), key).limit(k).where("similarity > 0")


def search(units: DataFrame, vectors: DataFrame, text: str, *, limit: int = 20, provider: str = "local-hash-v1", dimensions: int = 384) -> DataFrame:
    """``(unit_id, path, start_line, similarity)``: nearest fresh units of a text."""
    query = HashEmbedder(dimensions).embed(text).tolist()
    held = fresh(vectors.where((F.col("provider") == provider) & (F.col("dimensions") == dimensions)), units)
    near = top_k(held, query, limit)
    return near.join(units.select("unit_id", "path", "start_line").dropDuplicates(["unit_id"]), "unit_id").orderBy(F.desc("similarity"), "path", "start_line")
