"""Embedding tables as integer vectors (shared by operators 11 and 13).

``whole_numbers`` drops rows whose vector is null, empty or holds null or non-finite entries and
turns every entry c of the rest into floor(1024 * c) + shift.  The vectors that stay must have
one length and entries below ``LARGEST`` in size, so that squares and sums stay exact in 64
bits; anything else is an error that names the bound, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 18        # entries of an embedding are below this in size


def whole_numbers(rows: DataFrame, shift: int = 0) -> DataFrame:
    """(vec_id, label, x array<bigint>) of the rows that stay; without a label column, null."""
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    c = F.col("embedding")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    size = F.aggregate(c, F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))
    return (rows.where(c.isNotNull() & (F.size(c) > 0) & finite)
            .withColumn("embedding", F.when(size < LARGEST, c).otherwise(F.raise_error(
                F.lit(f"an entry of an embedding is {LARGEST} or more in size"))))
            .select("vec_id", label, F.transform("embedding", lambda v: F.floor(v.cast("double") * 1024.0) + shift)
                    .alias("x")))


def dimension(rows: DataFrame) -> int:
    """The one length of all vectors (0 without rows)."""
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} entries in one table")
    return low or 0


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time, without empty batches."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def sum_lists(rows: DataFrame, keys: list[str], lists: dict[str, int], sums: list[str] = ()) -> DataFrame:
    """Lists added up entry by entry over ``keys``: partial sums in every task, one shuffle of those."""
    parts = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c, n in lists.items() for i in range(n)]
    parts += [F.sum(c).alias(c) for c in sums]
    grouped = rows.groupBy(*keys).agg(*parts)
    return grouped.select(*keys, *sums, *[F.array(*[f"{c}_{i}" for i in range(n)]).alias(c) for c, n in lists.items()])
