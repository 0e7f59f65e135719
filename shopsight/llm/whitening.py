"""Embedding whitening by a bidiagonal qd solver (operator 13).

Spark reduces the rows to a triangle: exact sums S and the count n in one pass, then every
task takes its rows as (n x - S) / n, the numerator exact, and folds them block by block into
the triangle of a QR factorisation.  The tasks' triangles are merged ``FAN`` at a time, in
stages, until one is left, whatever their number; so neither the rows nor their triangles meet
in one place, and no covariance matrix is formed, whose squares would lose digits.  The last
triangle (dimension squared numbers) goes to the driver, which bidiagonalises it and finds
singular values and directions (``bidiagonal``).  One more pass projects the rows and sums up,
per task, what the covariance of the result needs.

Eigenvalues are squared singular values over n, ``explained`` is their share of the sum of all.
A direction's largest entry is positive.

Defined cases: see ``vectors`` for rows that are dropped or refused; all rows that stay belong
to the fit list, also repeated ones and those without vec_id; components without variance (fewer
distinct rows than components, constant dimensions) have null ``whitened`` and 0 ``explained``
and take no part in ``identity_error``; vectors shorter than the number of components have as
many components as entries; ``deviation`` is null where it exceeds 64 bits; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.bidiagonal import leading
from shopsight.llm.common import staged
from shopsight.llm.vectors import dimension, matrix, pieces, sum_lists, whole_numbers

SHIFT = 100_000
FAN = 16                 # triangles merged at once
ROWS = 4096              # rows folded at once


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]                      # of every dimension
    eigenvalues: np.ndarray              # of the components that have any, falling
    trace: float
    directions: np.ndarray               # a unit vector per row


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they fit, else as Python integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _offsets(x, n, sums).astype(float) / n


def _adder(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + matrix(b, dim).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()]})
    return run


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangle of a QR factorisation, square also for few rows."""
    dim = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == dim else np.vstack([r, np.zeros((dim - len(r), dim))])


def _folder(n: int, sums: list[int]):
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in pieces(batches, ROWS):
            part = _centred(matrix(b, dim), n, sums)
            r = _triangle(part if r is None else np.vstack([r, part]))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"block": [TaskContext.get().partitionId()], "r": [r.ravel().tolist()]},
                                             schema=pa.schema([("block", pa.int32()), ("r", pa.list_(pa.float64()))]))
    return run


def _merger(dim: int):
    def merge(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        ordered = blocks.sort_values("block")["r"]
        r = _triangle(np.vstack([np.asarray(b, float).reshape(dim, dim) for b in ordered]))
        return pd.DataFrame({"block": [int(key[0])], "r": [r.ravel()]})
    return merge


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangle of all centred rows: blocks in every task, then merged in stages."""
    schema, dim = "block int, r array<double>", len(sums)
    blocks = staged(rows.select("x").mapInArrow(_folder(n, sums), schema), "triangles")
    left = blocks.agg(F.max("block")).first()[0] + 1
    while left > 1:
        merged = (blocks.groupBy(F.floor(F.col("block") / FAN).cast("int").alias("to"))
                  .applyInPandas(_merger(dim), schema))
        blocks, left = staged(merged, "triangles"), -(-left // FAN)
    return np.array(blocks.first().r).reshape(dim, dim)


def fit(rows: DataFrame, components: int = 8) -> Whitening:
    """Mean, eigenvalues and directions of staged ``whole_numbers`` rows."""
    dim = dimension(rows)
    if not dim:
        return Whitening(0, [], np.zeros(0), 0.0, np.zeros((0, 0)))
    parts = rows.select("x").mapInArrow(_adder(dim), "n bigint, total array<bigint>")
    n, sums = sum_lists(parts, [], {"total": dim}, ["n"]).first()
    values, kept, directions = leading(triangle(rows, n, sums), components)
    return Whitening(n, list(sums), kept / n, float(values.sum()) / n, directions)


def _project(w: Whitening, x: np.ndarray) -> np.ndarray:
    return _centred(x, w.n, w.sums) @ w.directions.T / np.sqrt(w.eigenvalues)


def _moments(w: Whitening):
    """(n, mean, products): of each batch of a task, the products around the batch's own mean."""
    dim = len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, 0.0, 0.0
        for b in pieces(batches, ROWS):
            y = _project(w, matrix(b, dim))
            here = y.mean(0)
            y, step, total = y - here, here - mean, n + len(y)
            products = products + y.T @ y + np.outer(step, step) * (n * len(y) / total)
            n, mean = total, mean + step * (len(y) / total)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})
    return run


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(w.eigenvalues)
    if not k:
        return 0.0
    parts = staged(rows.select("x").mapInArrow(_moments(w), "n bigint, mean array<double>, products array<double>"),
                   "moments")
    weighted = parts.select("n", F.transform("mean", lambda m: m * F.col("n")).alias("mean"))
    mean = [s / w.n for s in sum_lists(weighted, [], {"mean": k}).first()[0]]
    away = F.array(*[F.col("mean")[i] - F.lit(m) for i, m in enumerate(mean)])
    around = parts.select("n", "products", away.alias("away")).select(F.array(*[
        F.col("products")[i * k + j] + F.col("n") * F.col("away")[i] * F.col("away")[j]
        for i in range(k) for j in range(k)]).alias("products"))
    covariance = np.array(sum_lists(around, [], {"products": k * k}).first()[0]).reshape(k, k) / w.n
    return float(np.abs(covariance - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S) squared, exact."""
    away = _offsets(x, n, sums)
    if int(np.abs(away).max(initial=0)) ** 2 * len(sums) >= 1 << 63:
        total = (away.astype(object) ** 2).sum(1)
        return pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())
    return pa.array((away ** 2).sum(1).astype(np.int64))


def _whitener(w: Whitening, components: int, error: float):
    dim = len(w.sums)
    count, have = min(components, dim), len(w.eigenvalues)
    share = [*(w.eigenvalues / w.trace if have else []), *[0.0] * (count - have)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, ROWS):
            x = matrix(b, dim)
            y = np.zeros((len(x), count))
            y[:, :have] = _project(w, x) if have else 0.0
            void = np.broadcast_to(np.arange(count) >= have, y.shape)
            at = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), w.n, np.int64)), _deviation(x, w.n, w.sums).take(at),
                 pa.array(y.ravel(), mask=void.ravel()), pa.array(np.tile(share, len(x))),
                 pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def apply(rows: DataFrame, w: Whitening, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of staged rows."""
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, "
              "whitened double, explained double, identity_error double")
    if not w.n:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "x").mapInArrow(_whitener(w, components, identity_error(rows, w)), schema)


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """Fit on all rows of an embedding table and whiten each of them."""
    numbers = staged(whole_numbers(rows, SHIFT), "vector-numbers")
    return apply(numbers, fit(numbers, components), components)
