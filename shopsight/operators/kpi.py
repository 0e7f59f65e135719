"""Revenue KPIs and customer metrics.

All aggregations are hash aggregates with a map-side partial step, so a tenant
holding a third of the rows is summed on every executor before the shuffle and
only one partial row per (task, key) moves.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Money sums stay exact: quantity * DECIMAL(18,4) summed as DECIMAL(38,4).
_SUM_TYPE = "decimal(38,4)"


def analytical_dataset(order_items: DataFrame) -> DataFrame:
    """D3: (tenant_id, buyer_id, total_amount) per line item."""
    return order_items.select(
        "tenant_id", F.col("customer_hash").alias("buyer_id"),
        (F.col("quantity") * F.col("price")).cast(_SUM_TYPE).alias("total_amount"))


def kpis(order_items: DataFrame, keys: Sequence[str] = ("tenant_id",),
         tenants: DataFrame | None = None) -> DataFrame:
    """D1 + D2: total revenue, distinct buyers and revenue per buyer (0 if none).  With the
    register of ``tenants``, every tenant has a row, those without items zeros."""
    ds = analytical_dataset(order_items)
    agg = ds.groupBy(*keys).agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("total_revenue"),
        F.count_distinct("buyer_id").alias("total_customers"))
    return with_average(agg, keys, tenants)


def with_average(agg: DataFrame, keys: Sequence[str], tenants: DataFrame | None = None) -> DataFrame:
    """D2 on revenue and buyers per key, with zeros for tenants that have none."""
    if tenants is not None:
        agg = tenants.select(*keys).distinct().join(agg, list(keys), "left").select(
            *keys, F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
            F.coalesce("total_customers", F.lit(0)).alias("total_customers"))
    avg = F.when(F.col("total_customers") > 0,
                 F.col("total_revenue") / F.col("total_customers")).otherwise(F.lit(0.0))
    return agg.withColumn("avg_revenue_per_customer", avg)


def order_totals(order_items: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Amount and last date of every (customer, order)."""
    return order_items.groupBy(*keys, "customer_hash", "order_id").agg(
        F.sum((F.col("quantity") * F.col("price")).cast(_SUM_TYPE)).alias("amount"),
        F.max("transaction_date").alias("transaction_date"))


def rfm_metrics(orders: DataFrame | None, order_items: DataFrame,
                keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Last order date, number of orders and spend per (tenant, buyer).

    Items are first summed per order (partial-aggregated), so the distinct count of
    orders becomes a plain count.  The fact table carries the order date, so no
    join with the headers is needed; ``orders`` is only used for item tables
    without a date column.
    """
    if "transaction_date" in order_items.columns:
        dated = (order_items
                 .groupBy(*keys, "customer_hash", "order_id")
                 .agg(F.sum((F.col("quantity") * F.col("price")).cast(_SUM_TYPE)).alias("__amount"),
                      F.max("transaction_date").alias("transaction_date")))
    else:
        per_order = (order_items
                     .groupBy(*keys, "customer_hash", "order_id")
                     .agg(F.sum((F.col("quantity") * F.col("price")).cast(_SUM_TYPE)).alias("__amount")))
        dated = per_order.join(orders.select("order_id", "transaction_date"), "order_id")
    return (dated.groupBy(*keys, F.col("customer_hash").alias("buyer_id"))
                 .agg(F.max("transaction_date").alias("last_order_date"),
                      F.count(F.lit(1)).alias("frequency"),
                      F.sum("__amount").cast("double").alias("monetary")))
