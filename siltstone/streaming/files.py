"""File records as a stream: the newest indexing of each path, kept in the store.

An extra on top of batch diffs: late and repeated records are harmless, since a
record only replaces an older one of its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.incremental import latest
from siltstone.sinks.tables import Store


def newest(rows: DataFrame) -> DataFrame:
    """One row per path: the last modified, of equal times the larger hash."""
    return latest(rows, ["path"], [F.desc("mtime_ns"), F.desc("content_hash"), F.desc_nulls_last("indexed_at")])


def keep_newest(stream: DataFrame, store: Store, checkpoint: str, table: str = "files", **trigger) -> StreamingQuery:
    """Start a query that upserts each micro-batch of file records into a store table.

    A batch that runs twice gives the same table, so the sink is exactly-once in effect.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        old = store.read(table) if store.version(table) else batch.limit(0)
        store.write(table, newest(old.select(*batch.columns).unionByName(batch)))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_window(stream: DataFrame, *, width: str = "1 day", late: str = "14 days") -> DataFrame:
    """Indexings per repository and time window, with records up to ``late`` after the newest one."""
    rows = stream.where("indexed_at is not null").withWatermark("indexed_at", late)
    return rows.groupBy(F.window("indexed_at", width), "repository").agg(F.count(F.lit(1)).alias("n"))
