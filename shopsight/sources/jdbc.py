"""JDBC extract of a user's source query (A1-A4, B12 at the source).

The user's SQL is wrapped as a derived table; in delta mode the date predicate
is added in the source dialect so the database filters before any row moves.
Columns are taken by position as (client, sku, qty, price, transaction_date).
Reads can be split over executors with ``partitionColumn`` bounds, and rows
arrive ``fetchsize`` at a time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

FEED_COLUMNS = ("client", "sku", "qty", "price", "transaction_date")

# The delta predicate per source dialect.
DELTA_PREDICATE = {
    "pg": "CAST(t.transaction_date AS TIMESTAMP) > '{ts}'",
    "mysql": "t.transaction_date > '{ts}'",
    "mssql": "CAST(t.transaction_date AS DATETIME) > '{ts}'",
}


def normalize_marker_text(marker: str | None) -> str | None:
    """ISO text -> 'yyyy-MM-dd HH:mm:ss' in UTC (driver-side twin of ``scalar.normalize_marker``)."""
    if not marker:
        return None
    when = datetime.fromisoformat(marker.strip())
    if when.tzinfo:
        when = when.astimezone(timezone.utc)
    return when.strftime("%Y-%m-%d %H:%M:%S")


def source_query(query: str, dialect: str, marker: str | None = None) -> str:
    """The statement sent to the source: the user's query, filtered in delta mode."""
    base = query.strip().rstrip(";")
    ts = normalize_marker_text(marker)
    if not ts:
        return base
    if dialect not in DELTA_PREDICATE:
        raise ValueError(f"unknown dialect {dialect!r}")
    return f"SELECT * FROM ({base}) AS t WHERE {DELTA_PREDICATE[dialect].format(ts=ts)}"


def read_source(spark: SparkSession, url: str, query: str, dialect: str, marker: str | None = None,
                partition_column: str | None = None, lower_bound=None, upper_bound=None,
                num_partitions: int | None = None, fetchsize: int = 1000, **options) -> DataFrame:
    """A1: the source query as a DataFrame with the five feed columns (by position).

    A split read needs ``partition_column`` and its bounds; ``num_partitions=1`` asks for
    one connection on purpose (a small source)."""
    if partition_column is None and num_partitions != 1:
        raise ValueError("name a partition_column with bounds, or ask for num_partitions=1")
    if partition_column is not None and (lower_bound is None or upper_bound is None):
        raise ValueError("partition_column needs lower_bound and upper_bound")
    reader = (spark.read.format("jdbc").option("url", url)
              .option("dbtable", f"({source_query(query, dialect, marker)}) src")
              .option("fetchsize", str(fetchsize)))
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 8)))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load()
    if len(df.columns) < len(FEED_COLUMNS):
        raise ValueError(f"source query returns {len(df.columns)} columns, 5 expected")
    return df.select(*df.columns[:len(FEED_COLUMNS)]).toDF(*FEED_COLUMNS)
