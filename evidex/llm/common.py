"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, staged

__all__ = ["crc_mod", "free_name", "raw", "schema_of", "shared_dir", "slices", "staged"]
#: Texts are handled in slices of about this many bytes, whatever Arrow's batch holds.
SLICE_BYTES = 4 << 20


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose `column` holds about `limit` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column's UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def schema_of(df: DataFrame, *columns: str) -> str:
    """DDL of some of a frame's columns."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have."""
    while base in df.columns:
        base += "_"
    return base
