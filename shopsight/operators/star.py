"""Star-schema upkeep with natural keys.

Keys: customers (tenant_id, customer_hash), products (tenant_id, product_code),
orders order_id (uuid5 of tenant, client hash and date text), order_items are
tagged with the ``batch_id`` that wrote them so a replayed batch replaces its
own rows instead of duplicating them.

All functions are pure DataFrame -> DataFrame steps; persistence lives in
``shopsight.sources.store``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.functions.scalar import (order_id_name, order_number, uuid5_digest,
                                        uuid_from_digest)
from shopsight.schemas import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS, TENANTS


@dataclass(frozen=True)
class Star:
    tenants: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame

    @staticmethod
    def empty(spark: SparkSession, tenants: DataFrame | None = None) -> "Star":
        e = lambda s: spark.createDataFrame([], s)
        return Star(tenants if tenants is not None else e(TENANTS), e(CUSTOMERS), e(PRODUCTS),
                    e(ORDERS), e(ORDER_ITEMS))


# --- C1: tenant resolution --------------------------------------------------

def resolve_tenant(feed: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach ``tenant_id`` by integration key; rows with an unknown or missing key are
    returned separately (the reference rejects the whole batch)."""
    t = tenants.select("tenant_key", "tenant_id")
    accepted = feed.drop("tenant_id").join(t, "tenant_key", "inner")
    rejected = feed.join(t, "tenant_key", "left_anti")
    return accepted, rejected


# --- C4/C5/C6: order headers ----------------------------------------------------

def with_order_id(clean: DataFrame) -> DataFrame:
    """Add the deterministic order id (one client at one date string per tenant)."""
    # two projections: the digest is not cheap, so Catalyst keeps it computed once
    return (clean.withColumn("__dg", uuid5_digest(order_id_name("tenant_id", "client_hash", "order_date")))
                 .withColumn("order_id", uuid_from_digest("__dg")).drop("__dg"))


def batch_orders(clean_with_ids: DataFrame) -> DataFrame:
    """Order headers of a batch, first occurrence wins (all fields follow from the id)."""
    return (clean_with_ids
            .select("order_id", "tenant_id", F.col("client_hash").alias("customer_hash"),
                    "transaction_date")
            .dropDuplicates(["order_id"])
            .withColumn("order_number", order_number("order_id")))


def upsert_orders(current: DataFrame, batch_orders_df: DataFrame) -> DataFrame:
    """Insert headers whose id is new; existing ids are left untouched (DO NOTHING)."""
    new = batch_orders_df.join(current.select("order_id"), "order_id", "left_anti")
    return current.unionByName(new.select(*current.columns))


# --- C2: customers ----------------------------------------------------------------

def upsert_customers(current: DataFrame, batch: DataFrame) -> DataFrame:
    new = (batch.select("tenant_id", F.col("client_hash").alias("customer_hash")).distinct()
                .join(current, ["tenant_id", "customer_hash"], "left_anti"))
    return current.unionByName(new)


# --- C3: products, last price wins ---------------------------------------------------

def latest_prices(batch: DataFrame, seq_cols: Sequence[str]) -> DataFrame:
    """Per (tenant, product) the price of the last row in arrival order."""
    seq = F.struct(*[F.col(c) for c in seq_cols])
    return batch.groupBy("tenant_id", "product_code").agg(F.max_by("price", seq).alias("price"))


def upsert_products(current: DataFrame, batch: DataFrame, seq_cols: Sequence[str]) -> DataFrame:
    new = latest_prices(batch, seq_cols).withColumnRenamed("price", "__new")
    j = current.join(new, ["tenant_id", "product_code"], "full_outer")
    return j.select("tenant_id", "product_code",
                    F.coalesce(F.col("__new"), F.col("price")).cast(PRODUCTS["price"].dataType).alias("price"))


# --- C7 / L3: line items ----------------------------------------------------------------

def batch_items(clean_with_ids: DataFrame, batch_id: int) -> DataFrame:
    return clean_with_ids.select(
        "order_id", "tenant_id", "product_code", "quantity", "price",
        F.col("client_hash").alias("customer_hash"), "transaction_date",
        F.lit(batch_id).cast("long").alias("batch_id"))


def append_items(current: DataFrame | None, items: DataFrame, batch_id: int,
                 customers: DataFrame | None = None,
                 products: DataFrame | None = None) -> DataFrame:
    """Keep items whose customer and product exist, replace rows of the same batch id
    (a replayed batch overwrites itself instead of duplicating).

    Pass ``customers=None, products=None`` when the dimensions were upserted from the
    same batch: every key then exists by construction and two shuffles are saved.
    """
    checked = items
    if customers is not None:
        checked = checked.join(customers, ["tenant_id", "customer_hash"], "left_semi")
    if products is not None:
        checked = checked.join(products.select("tenant_id", "product_code"),
                               ["tenant_id", "product_code"], "left_semi")
    checked = checked.select(*ORDER_ITEMS.fieldNames())
    if current is None:
        return checked
    kept = current.filter(F.col("batch_id") != F.lit(batch_id))
    return kept.unionByName(checked)


# --- C8 / L2: sync marker ------------------------------------------------------------------

def update_marker(tenants: DataFrame, batch: DataFrame, mode: str = "event",
                  now: str | None = None) -> DataFrame:
    """New ``last_sync_date`` per tenant touched by a non-empty batch.

    ``mode="event"``: the newest transaction date seen (late rows are not lost);
    ``mode="ingest"``: the load time ``now`` (the reference's behaviour).
    """
    if mode == "event":
        touched = batch.groupBy("tenant_id").agg(F.max("transaction_date").alias("__m"))
        newer = F.greatest(F.col("last_sync_date"), F.col("__m"))
    elif mode == "ingest":
        stamp = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
        touched = batch.select("tenant_id").distinct().withColumn("__m", stamp)
        newer = F.col("__m")
    else:
        raise ValueError(f"unknown marker mode {mode!r}")
    j = tenants.join(touched, "tenant_id", "left")
    return j.select(*[F.when(F.col("__m").isNotNull(), newer).otherwise(F.col("last_sync_date"))
                      .alias("last_sync_date") if c == "last_sync_date" else F.col(c)
                      for c in tenants.columns])


def read_marker(tenants: DataFrame, tenant_key: str) -> DataFrame:
    return tenants.filter(F.col("tenant_key") == tenant_key).select("tenant_key", "last_sync_date")


# --- J4 core: one batch into the star --------------------------------------------------------

def load_batch(star: Star, clean: DataFrame, batch_id: int, seq_cols: Sequence[str],
               marker_mode: str = "event", now: str | None = None) -> Star:
    """C2, C3, C6, C7, C8 for one clean batch (columns of ``clean_feed`` + tenant_id)."""
    with_ids = with_order_id(clean)
    customers = upsert_customers(star.customers, clean)
    products = upsert_products(star.products, clean, seq_cols)
    orders = upsert_orders(star.orders, batch_orders(with_ids))
    # customers and products were just upserted from this batch: no lookup needed
    items = append_items(star.order_items, batch_items(with_ids, batch_id), batch_id)
    tenants = update_marker(star.tenants, clean, marker_mode, now)
    return replace(star, tenants=tenants, customers=customers, products=products,
                   orders=orders, order_items=items)


def star_from_clean(spark: SparkSession, clean: DataFrame, seq_cols: Sequence[str],
                    tenants: DataFrame | None = None, batch_id: int = 0,
                    marker_mode: str = "event", now: str | None = None) -> Star:
    """A whole clean feed as the first batch (the full-load path): the tables are
    built directly, with no anti joins against empty tables."""
    if tenants is None:
        tenants = spark.createDataFrame([], TENANTS)
    with_ids = with_order_id(clean)
    customers = clean.select("tenant_id", F.col("client_hash").alias("customer_hash")).distinct()
    products = latest_prices(clean, seq_cols).select(
        "tenant_id", "product_code", F.col("price").cast(PRODUCTS["price"].dataType).alias("price"))
    return Star(tenants=update_marker(tenants, clean, marker_mode, now), customers=customers,
                products=products, orders=batch_orders(with_ids),
                order_items=append_items(None, batch_items(with_ids, batch_id), batch_id))
