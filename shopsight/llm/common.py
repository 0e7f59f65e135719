"""Plan helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.session import scratch_path

BROADCAST_ROWS = 1_000_000        # id lists up to this many rows (8 MB of longs) may be broadcast
SHARE = 1000                      # a key with more than 1/SHARE of all rows is hot: fewer than SHARE keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back: cuts the lineage, is
    computed once however many branches read it, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when a staged table is proven small, else the plain frame."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; absent extras and clashing names never reach the operator."""
    return df.select(*[F.col(n) for n in names])


def even_join(rows: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, total: int,
              how: str = "inner", most: int = 1024) -> DataFrame:
    """Join on ``key`` with the hot keys of ``rows`` split over tasks, whatever their size.

    ``counts`` (key, n) holds the rows of each key, ``total`` their sum.  A key with more than
    1/SHARE of all rows is cut by ``by`` into parts, a power of two and at most ``most``, and
    its rows of ``right`` are repeated once a part: fewer than 4 SHARE repeats in all where
    ``right`` holds a key once.  The hot keys, fewer than SHARE of them, are literals of the
    plan, so the rows pass no other join."""
    hot: dict[int, list] = {}
    for r in counts.filter(F.col("n") * SHARE > total).select(key, "n").collect():       # < SHARE rows
        hot.setdefault(min(most, 1 << (-(-r["n"] * SHARE // total) - 1).bit_length()), []).append(r[key])
    parts = F.lit(1)
    for n, keys in hot.items():
        parts = F.when(F.col(key).isin(keys), F.lit(n)).otherwise(parts)
    left = rows.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    each = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(each, [key, "_part"], how).drop("_part")
