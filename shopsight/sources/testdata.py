"""Adapters from the driver's parquet tables to the engine's inputs.

The tables under ``<sf_dir>/<name>.parquet`` stand in for the reference's
sources: a sales feed (order lines with client, sku, quantity, price, date), a
tenant list, basket transactions and a report log.  Every adapter is a lazy
DataFrame plan over the parquet scans, so filters and column pruning reach the
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed parameters of the test fixtures.
DELTA_MARKER = "1998-01-01 00:00:00"
UNKNOWN_TENANT_KEY = "key_unknown"
N_BATCHES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sales feed: one row per order line, tenant = customer nation."""
    return feed_from_lines(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def feed_from_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame) -> DataFrame:
    """The feed for a set of order lines (a whole table or one streamed batch)."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # headers get their client first: lines move twice, while they are narrow
    j = (li.join(pa, li.l_partkey == pa.p_partkey)
           .join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey))
    return j.select(
        F.col("c_nationkey").alias("tenant_id"),
        F.concat(F.lit("key_"), F.col("c_nationkey").cast("string")).alias("tenant_key"),
        F.col("c_name").alias("client"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("p_brand").alias("brand"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").alias("transaction_date"),
        "l_orderkey", "l_linenumber",
    )


def dirty_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with fixed defects keyed on ``l_orderkey`` (quantity as text)."""
    return with_defects(feed(spark, sf_dir))


def with_defects(f: DataFrame) -> DataFrame:
    """A clean feed (a whole table or one streamed batch) with the fixed defects."""
    k = F.col("l_orderkey")
    client = (F.when(k % 17 == 0, F.lit(None).cast("string"))
               .when(k % 19 == 0, F.lit("  "))
               .when(k % 13 == 0, F.concat(F.lit(" \t"), F.col("client"), F.lit("  ")))
               .otherwise(F.col("client")))
    sku = F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("sku"))
    qty = (F.when(k % 29 == 0, F.lit("3.0"))
            .when(k % 31 == 0, F.lit("-2"))
            .when(k % 37 == 0, F.lit("x"))
            .otherwise(F.col("qty").cast("string")))
    price = F.when(k % 41 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("price"))
    return f.select("tenant_id", "tenant_key", client.alias("client"), sku.alias("sku"), "brand",
                    qty.alias("qty"), price.alias("price"), "transaction_date",
                    "l_orderkey", "l_linenumber")


def batch_of(df: DataFrame, batch: int, n_batches: int = N_BATCHES) -> DataFrame:
    """Cut a feed into load batches by ``l_orderkey % n``."""
    return df.filter(F.col("l_orderkey") % n_batches == batch)


def feed_sequence() -> list:
    """Arrival order of feed rows: date, order key, line number, then the price itself."""
    return ["transaction_date", "l_orderkey", "l_linenumber", "price"]


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant register: one tenant per nation with integration key ``key_<n>``."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("int").alias("tenant_id"),
        F.col("n_name").alias("company_name"),
        F.concat(F.lit("key_"), F.col("n_nationkey").cast("string")).alias("tenant_key"),
        F.lit(None).cast("timestamp_ntz").alias("last_sync_date"),
    )


def keyed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows as they arrive with an integration key; every 53rd order has a bad key."""
    f = feed(spark, sf_dir)
    key = F.when(F.col("l_orderkey") % 53 == 0, F.lit(UNKNOWN_TENANT_KEY)).otherwise(F.col("tenant_key"))
    return f.drop("tenant_id").withColumn("tenant_key", key)


def brand_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket transactions: order = l_orderkey, item = p_brand, tenant = customer nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (li.join(pa, li.l_partkey == pa.p_partkey)
           .join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey))
    return j.select(F.col("c_nationkey").alias("tenant_id"),
                    F.col("l_orderkey").cast("string").alias("order_id"),
                    F.col("p_brand").alias("product_code"))


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report log stand-in: tenant = user_id % 5, type = event_type, created_at = ts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("report_id"),
        (F.col("user_id") % 5).cast("int").alias("tenant_id"),
        F.col("event_type").alias("report_type"),
        F.to_json(F.struct(F.col("event_id"), F.col("value"))).alias("payload"),
        F.col("ts").alias("created_at"),
    )


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook-like rows (Customer ID as float, text Price/Quantity with junk)."""
    f = feed(spark, sf_dir)
    k = F.col("l_orderkey")
    cust = F.regexp_extract(F.col("client"), r"(\d+)$", 1).cast("double")
    return f.select(
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(cust).alias("Customer ID"),
        F.substring_index(F.col("sku"), "-", -1).cast("long").alias("StockCode"),
        F.when(k % 29 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string")).alias("Price"),
        (F.when(k % 31 == 0, F.lit("x"))
          .when(k % 37 == 0, F.lit("2.5"))
          .otherwise(F.col("qty").cast("string"))).alias("Quantity"),
        F.col("transaction_date").alias("InvoiceDate"),
        "l_orderkey", "l_linenumber",
    )
