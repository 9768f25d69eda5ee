"""Arrow batches from plain rows."""

from __future__ import annotations


def batch(rows: list[dict], schema: str):
    """A record batch of dict rows for a flat schema such as ``a string, n int``; missing keys are null."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])
