"""Parquet storage of the star schema and of reports.

The star is kept as the classified lines of every delivered batch, in plain partitioned Parquet:

    <base>/lines/batch_key=<source:batch>/tenant_bucket=<n>/    rows with order id and reject reason
    <base>/batches/batch_key=<source:batch>/                    counters of the batch, one row

Delivering a batch again overwrites its partition, so all of its rows are replaced, tenants
that are missing from the new delivery included (the reference duplicates line items
instead).  A delivery that fails is delivered again by its source, as streams do.  ``snapshot``
derives the tables by the upsert rules, as aggregations: customers distinct, products' price of
the last batch, orders of the first batch, items all rows, markers newest.  Batches follow each
other by (batch id, source).  Tenants are dealt over a fixed number of buckets, so the folders
do not grow with the tenants, and a tenant filter reads one bucket.

Reports are headers and detail tables, partitioned by tenant.  Reading them needs no file: an
empty or missing table has its schema and no rows.
"""

from __future__ import annotations

from typing import Iterable, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shopsight.functions.scalar import order_number
from shopsight.operators import cleaning
from shopsight.operators import star as st
from shopsight.schemas import ASSIGNMENT_ROWS, BATCHES, PRODUCTS, REPORTS, RULE_ROWS
from shopsight.session import staged

BUCKETS = 16


def by_tenant(df: DataFrame, *cols: str) -> DataFrame:
    """Lay rows out for a write partitioned by tenant: the REBALANCE hint lets AQE
    make reasonably sized files per tenant folder and still split a hot tenant
    over several tasks (instead of one file per task and tenant)."""
    return df.hint("rebalance", "tenant_id", *cols)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table by its schema; without any file, no rows."""
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(empty.schema).parquet(path).select(empty.columns) if path_exists(spark, path) else empty


def drop_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for f in folders:
        folder = hadoop.Path(f)
        folder.getFileSystem(conf).delete(folder, True)


class StarStore:
    def __init__(self, base: str, buckets: int = BUCKETS):
        self.base = base.rstrip("/")
        self.buckets = buckets

    # --- writing --------------------------------------------------------------------

    def write_feed(self, feed: DataFrame, batch_id: int, seq_cols: Sequence[str], source: str = "load",
                   keep: Sequence[str] = (), load_time: str | None = None, tenants: DataFrame | None = None,
                   new_since: Column | None = None) -> DataFrame:
        """One raw feed batch, read once: its rows are classified, counted and written in the same
        pass; returns the counters per tenant, from the written rows.  With ``tenants``, the
        integration key is resolved first and rows of unknown keys are only counted.  With
        ``new_since``, clean rows that other batches hold since that time are left out."""
        if "tenant_id" not in feed.columns:
            if tenants is None:
                raise ValueError("a feed without tenant_id needs the tenant register")
            feed = feed.join(tenants.select("tenant_key", "tenant_id"), "tenant_key", "left")
        if new_since is None:                # the raw lines are moved, before hashes and ids make them wide
            feed = feed.withColumn("tenant_bucket", self._bucket(F.col("tenant_id"))).hint("rebalance", "tenant_bucket")
        rows = cleaning.clean_classified(cleaning.classify_feed(feed), ("tenant_id", *keep, *seq_cols, "tenant_bucket"),
                                         all_rows=True)
        self._write(rows, batch_id, seq_cols, load_time, source, new_since)
        written = self.lines(feed.sparkSession).filter(F.col("batch_key") == f"{source}:{batch_id}")
        return cleaning.classified_stats(written)

    def write_batch(self, clean: DataFrame, batch_id: int, seq_cols: Sequence[str],
                    load_time: str | None = None, source: str = "load") -> None:
        """Write one clean batch (``clean_feed`` columns + tenant_id + sequence columns)."""
        self._write(clean.withColumn("reject_reason", F.lit(None).cast("string")), batch_id, seq_cols, load_time, source)

    def _write(self, rows: DataFrame, batch_id: int, seq_cols: Sequence[str], load_time: str | None, source: str,
               new_since: Column | None = None) -> None:
        folder = f"batch_key={quote(f'{source}:{batch_id}', safe='')}"
        known, good = F.col("tenant_id").isNotNull(), F.col("reject_reason").isNull()
        placed = "tenant_bucket" in rows.columns
        seen = Observation()
        counted = rows.observe(
            seen, F.count("tenant_id").alias("processed"), F.count_if(known & good).alias("sent"),
            F.count_if(known & ~good).alias("filtered"), F.count_if(~known).alias("unknown_key"))
        stamp = F.lit(load_time).cast("timestamp_ntz") if load_time else F.localtimestamp()
        lines = st.with_order_id(counted.filter(known)).select(
            "tenant_id", "client_hash", "product_code", "quantity", "price", "transaction_date", "order_id",
            "reject_reason", F.lit(batch_id).cast("long").alias("batch_id"), F.struct(*seq_cols).alias("seq"),
            stamp.alias("load_time"),
            F.col("tenant_bucket") if placed else self._bucket(F.col("tenant_id")).alias("tenant_bucket"))
        if new_since is not None and path_exists(rows.sparkSession, f"{self.base}/lines"):
            clean = F.col("reject_reason").isNull()
            others = self.lines(rows.sparkSession).filter(
                clean & (F.col("batch_key") != f"{source}:{batch_id}") & (F.col("transaction_date") > new_since))
            key = ["tenant_id", "client_hash", "product_code", "quantity", "price", "transaction_date", "seq"]
            lines = staged(lines, "delivered-lines")             # the folder below is read and written
            others = staged(others.select(*key), "stored-lines")
            newest = others.agg(F.max("transaction_date").alias("t")).first()["t"]
            # what is newer than all that is stored needs no look
            older = clean & (F.col("transaction_date") <= F.lit(str(newest)).cast("timestamp_ntz")) if newest is not None else F.lit(False)
            lines = lines.filter(~older).unionByName(cleaning.unseen(lines.filter(older), others, key))
        (lines if placed else lines.hint("rebalance", "tenant_bucket")).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("tenant_bucket").parquet(
            f"{self.base}/lines/{folder}")
        n = seen.get
        row = [(batch_id, *[n[c] for c in ("processed", "sent", "filtered", "unknown_key")])]
        (rows.sparkSession.createDataFrame(row, BATCHES).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.base}/batches/{folder}"))

    def _bucket(self, tenant):
        return F.pmod(F.hash(tenant.cast("long")), F.lit(self.buckets))

    # --- reading ----------------------------------------------------------------------

    def batches(self, spark: SparkSession) -> DataFrame:
        """Counters of every batch."""
        return read_table(spark, f"{self.base}/batches", f"{BATCHES}, batch_key string")

    def lines(self, spark: SparkSession, tenant_id: int | None = None) -> DataFrame:
        """The classified lines of all batches, or of one tenant."""
        if not path_exists(spark, f"{self.base}/lines"):
            raise ValueError(f"{self.base} holds no batch")
        df = spark.read.parquet(f"{self.base}/lines")
        if tenant_id is not None:
            df = df.filter((F.col("tenant_bucket") == self._bucket(F.lit(tenant_id))) & (F.col("tenant_id") == tenant_id))
        return df

    def snapshot(self, spark: SparkSession, tenants: DataFrame | None = None,
                 marker_mode: str = "event", tenant_id: int | None = None) -> st.Star:
        lines = self.lines(spark, tenant_id).filter(F.col("reject_reason").isNull()).withColumnRenamed(
            "client_hash", "customer_hash")
        order = F.struct("batch_id", "batch_key")
        cust = lines.select("tenant_id", "customer_hash").distinct()
        prod = lines.groupBy("tenant_id", "product_code").agg(
            F.max_by("price", F.struct("batch_id", "batch_key", "seq")).cast(PRODUCTS["price"].dataType).alias("price"))
        # the tenant is part of the key, so a tenant filter reaches the scan
        orders = (lines.groupBy("tenant_id", "order_id")
                  .agg(F.min_by(F.struct("customer_hash", "transaction_date"), order).alias("o"))
                  .select("order_id", "tenant_id", "o.customer_hash", "o.transaction_date",
                          order_number("order_id").alias("order_number")))
        items = lines.select("order_id", "tenant_id", "product_code", "quantity", "price", "customer_hash",
                             "transaction_date", "batch_id")
        m = lines.groupBy("tenant_id").agg(
            F.max("transaction_date" if marker_mode == "event" else "load_time").alias("__m"))
        if tenants is None:
            tenants = m.select("tenant_id").withColumn("company_name", F.lit(None).cast("string")) \
                       .withColumn("tenant_key", F.lit(None).cast("string")) \
                       .withColumn("last_sync_date", F.lit(None).cast("timestamp_ntz"))
        t = tenants.join(m, "tenant_id", "left").select(
            *[F.coalesce(F.col("__m"), F.col("last_sync_date")).alias("last_sync_date")
              if c == "last_sync_date" else F.col(c) for c in tenants.columns])
        return st.Star(tenants=t, customers=cust, products=prod, orders=orders, order_items=items)


def write_star(star: st.Star, base: str) -> None:
    """Every table of an in-memory star as Parquet partitioned by tenant."""
    for name in ("customers", "products", "orders", "order_items"):
        by_tenant(getattr(star, name)).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{base}/{name}")
    star.tenants.write.mode("overwrite").parquet(f"{base}/tenants")


class ReportStore:
    """Report headers plus detail tables (rules, assignments), appended per run."""

    DETAILS = {"rules": RULE_ROWS, "assignments": ASSIGNMENT_ROWS}

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def append(self, headers: DataFrame, details: dict[str, DataFrame]) -> None:
        """Details first: a report whose header is there is whole."""
        for name, df in details.items():
            by_tenant(df).write.mode("append").partitionBy("tenant_id").parquet(f"{self.base}/{name}")
        by_tenant(headers).write.mode("append").partitionBy("tenant_id", "report_type").parquet(f"{self.base}/headers")

    def headers(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, f"{self.base}/headers", REPORTS)

    def details(self, spark: SparkSession, name: str) -> DataFrame:
        return read_table(spark, f"{self.base}/{name}", self.DETAILS[name])

    def retain(self, spark: SparkSession, keep: int = 3) -> None:
        """The ``keep`` newest reports per (tenant, type) and their details stay.

        Only partitions that hold an expired report are written again, from a copy of the rows
        that stay; the files of all others are not touched.  Headers go last, so a run that
        is broken off finds its expired reports again."""
        from shopsight.operators.reports import retain_latest
        headers = self.headers(spark)
        kept = retain_latest(headers, keep).select("report_id")
        expired = staged(headers.join(kept, "report_id", "left_anti").select("report_id", "tenant_id", "report_type"),
                         "expired-reports")
        if expired.isEmpty():
            return
        for name in self.DETAILS:
            self._without(spark, name, self.details(spark, name), expired, ["tenant_id"])
        self._without(spark, "headers", headers, expired, ["tenant_id", "report_type"])

    def _without(self, spark: SparkSession, name: str, rows: DataFrame, expired: DataFrame, parts: list[str]) -> None:
        """Write the partitions of ``rows`` again that hold a row of an expired report."""
        ids = expired.select("report_id").distinct()
        touched = staged(rows.join(ids, "report_id", "left_semi").select(*parts).distinct(), "touched-partitions")
        left = staged(rows.join(touched, parts, "left_semi").join(ids, "report_id", "left_anti"), "kept-reports")
        by_tenant(left).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts) \
            .parquet(f"{self.base}/{name}")
        # an overwrite leaves partitions alone that get no row
        drop_folders(spark, ("/".join([self.base, name, *[f"{c}={r[c]}" for c in parts]])
                             for r in touched.join(left.select(*parts).distinct(), parts, "left_anti").toLocalIterator()))
