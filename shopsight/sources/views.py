"""Customer metrics and KPIs kept up to date batch by batch.

    <base>/orders/batch_key=<source:batch>/period=<p>/tenant_bucket=<n>/   what a batch holds of an order
    <base>/customers/period=<p>/tenant_bucket=<n>/                         a customer's orders of a period
    <base>/pending/batch_key=<source:batch>/                               partitions still to be merged

An order id follows from tenant, client and date text, so all lines of an order lie in one period,
whichever batches bring them: numbers of distinct orders, sums and last dates per (customer,
period) add up over periods without an owner per order.  ``refresh`` sums one batch's lines per
order, replaces the parts that the batch had before, and merges again only the (period, tenant
bucket) partitions that the batch holds now or held before; other partitions are neither read nor
written.  A redelivered batch replaces its own share.  The partitions to merge are noted before the
parts are replaced, so a refresh that is broken off is made good by the next one of any batch.

What the driver sees are names of partitions, at most periods times buckets.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.operators import kpi
from shopsight.session import staged
from shopsight.sources.store import StarStore, drop_folders, path_exists, read_table

PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
_PLACE = "period string, tenant_bucket int"
_ORDERS = (f"tenant_id int, buyer_id string, order_id string, amount decimal(38,4), last_order_date timestamp_ntz, "
           f"batch_key string, {_PLACE}")
_CUSTOMERS = (f"tenant_id int, buyer_id string, amount decimal(38,4), frequency bigint, "
              f"last_order_date timestamp_ntz, {_PLACE}")


class CustomerViews:
    def __init__(self, base: str, period: str = "month"):
        self.base = base.rstrip("/")
        self.period = PERIODS[period]

    # --- keeping up to date ------------------------------------------------------------

    def refresh(self, spark: SparkSession, store: StarStore, batch_id: int, source: str = "load") -> None:
        """Take over a batch that ``store`` has just written."""
        key = f"{source}:{batch_id}"
        name = f"batch_key={quote(key, safe='')}"
        lines = store.lines(spark).filter((F.col("batch_key") == key) & F.col("reject_reason").isNull())
        parts = staged(
            kpi.order_totals(lines.withColumnRenamed("client_hash", "customer_hash"), ("tenant_id", "tenant_bucket"))
            .select("tenant_id", F.col("customer_hash").alias("buyer_id"), "order_id", "amount",
                    F.col("transaction_date").alias("last_order_date"),
                    F.date_format("transaction_date", self.period).alias("period"), "tenant_bucket"), "order-parts")
        before = self._orders(spark).filter(F.col("batch_key") == key)
        touched = parts.select("period", "tenant_bucket").union(before.select("period", "tenant_bucket")).distinct()
        noted = read_table(spark, f"{self.base}/pending", f"{_PLACE}, batch_key string").filter(F.col("batch_key") == key)
        touched = staged(touched.union(noted.select("period", "tenant_bucket")).distinct(), "touched-partitions")
        touched.write.mode("overwrite").parquet(f"{self.base}/pending/{name}")
        (parts.hint("rebalance", "period", "tenant_bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("period", "tenant_bucket")
         .parquet(f"{self.base}/orders/{name}"))
        self.merge(spark)

    def merge(self, spark: SparkSession) -> None:
        """Merge the noted partitions again from the parts of all batches."""
        if not path_exists(spark, f"{self.base}/pending"):
            return
        noted = read_table(spark, f"{self.base}/pending", f"{_PLACE}, batch_key string").collect()
        places = {(r.period, r.tenant_bucket) for r in noted}
        if places:
            view = staged(self._merged(self._parts(spark, places)), "merged-customers")
            (view.hint("rebalance", "period", "tenant_bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("period", "tenant_bucket")
             .parquet(f"{self.base}/customers"))
            # an overwrite leaves partitions alone that get no row
            filled = {(r.period, r.tenant_bucket) for r in view.select("period", "tenant_bucket").distinct().collect()}
            drop_folders(spark, [f"{self.base}/customers/period={p}/tenant_bucket={b}" for p, b in places - filled])
        drop_folders(spark, {f"{self.base}/pending/batch_key={quote(r.batch_key, safe='')}" for r in noted})

    def _orders(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, f"{self.base}/orders", _ORDERS)

    def _parts(self, spark: SparkSession, places: set) -> DataFrame:
        """The order parts of some partitions; the conditions prune folders."""
        wanted = spark.createDataFrame(sorted(places), _PLACE)
        return (self._orders(spark)
                .filter(F.col("period").isin(sorted({p for p, _ in places}))
                        & F.col("tenant_bucket").isin(sorted({b for _, b in places})))
                .join(F.broadcast(wanted), ["period", "tenant_bucket"], "left_semi"))

    @staticmethod
    def _merged(parts: DataFrame) -> DataFrame:
        place = ["tenant_id", "buyer_id", "period", "tenant_bucket"]
        orders = parts.groupBy(*place, "order_id").agg(
            F.sum("amount").alias("amount"), F.max("last_order_date").alias("last_order_date"))
        return orders.groupBy(*place).agg(
            F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("frequency"),
            F.max("last_order_date").alias("last_order_date"))

    # --- reading -----------------------------------------------------------------------

    def _customers(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, f"{self.base}/customers", _CUSTOMERS).groupBy("tenant_id", "buyer_id").agg(
            F.max("last_order_date").alias("last_order_date"), F.sum("frequency").alias("frequency"),
            F.sum("amount").alias("amount"))

    def customer_metrics(self, spark: SparkSession) -> DataFrame:
        """D4, as ``kpi.rfm_metrics`` over all items."""
        return self._customers(spark).select("tenant_id", "buyer_id", "last_order_date", "frequency",
                                             F.col("amount").cast("double").alias("monetary"))

    def kpis(self, spark: SparkSession, tenants: DataFrame | None = None) -> DataFrame:
        """D1 + D2, as ``kpi.kpis`` over all items."""
        sums = self._customers(spark).groupBy("tenant_id").agg(
            F.sum("amount").cast("double").alias("total_revenue"), F.count(F.lit(1)).alias("total_customers"))
        return kpi.with_average(sums, ("tenant_id",), tenants)
