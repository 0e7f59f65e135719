"""Feed ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.operators import cleaning
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.sources import testdata as td

CAP = 25000

_DIRTY_CLEAN = S.DIRTY_FEED + "," + S.classify("dirty") + "," + S.clean("dirty")
_CLEAN_COLS = ("tenant_id, client_hash, product_code, quantity, CAST(price AS DOUBLE) AS price, "
               "order_date, transaction_date")


def _clean_out(df):
    return df.select("tenant_id", "client_hash", "product_code", "quantity",
                     F.col("price").cast("double").alias("price"), "order_date", "transaction_date")


@query("feed_clean", covers="B1 B2 B3 B4 B5 B8",
       sql=S.with_(_DIRTY_CLEAN, f"SELECT {_CLEAN_COLS} FROM clean"))
def feed_clean(spark, sf_dir):
    return _clean_out(common.clean_dirty_feed(spark, sf_dir))


@query("feed_rejected", covers="B7",
       sql=S.with_(S.DIRTY_FEED + "," + S.classify("dirty"),
                   "SELECT tenant_id, l_orderkey, l_linenumber, client, sku, qty, "
                   "CAST(price AS DOUBLE) AS price, reject_reason FROM dirty_c "
                   "WHERE reject_reason IS NOT NULL"))
def feed_rejected(spark, sf_dir):
    r = cleaning.rejected_feed(td.dirty_feed(spark, sf_dir))
    return r.select("tenant_id", "l_orderkey", "l_linenumber", "client", "sku", "qty",
                    F.col("price").cast("double").alias("price"), "reject_reason")


@query("feed_stats", covers="B6",
       sql=S.with_(S.DIRTY_FEED + "," + S.classify("dirty"),
                   "SELECT tenant_id, count(*) AS processed, "
                   "count(*) FILTER (WHERE reject_reason IS NULL) AS sent, "
                   "count(*) FILTER (WHERE reject_reason IS NOT NULL) AS filtered "
                   "FROM dirty_c GROUP BY tenant_id"))
def feed_stats(spark, sf_dir):
    return cleaning.ingest_stats(td.dirty_feed(spark, sf_dir))


@query("feed_delta", covers="B12 B13",
       sql=S.with_(_DIRTY_CLEAN, f"SELECT {_CLEAN_COLS} FROM clean "
                                 f"WHERE transaction_date > TIMESTAMP '{td.DELTA_MARKER}'"))
def feed_delta(spark, sf_dir):
    # the marker arrives as ISO text with 'T' and fractions; it is normalised first
    marker = td.DELTA_MARKER.replace(" ", "T") + ".123456+00:00"
    return _clean_out(cleaning.clean_feed(
        cleaning.delta(td.dirty_feed(spark, sf_dir), marker), keep=common.CLEAN_KEEP))


_CAP_ORDER = ["transaction_date", "l_orderkey", "l_linenumber", "price", "sku", "qty", "client"]


@query("feed_capped", covers="A3 B10",
       sql=S.with_(S.DIRTY_FEED + f",\ncapped AS (SELECT *, row_number() OVER (ORDER BY "
                   + ", ".join(f"{c} NULLS FIRST" for c in _CAP_ORDER) + f") <= {CAP} AS within_cap FROM dirty),"
                   + S.classify("capped"),
                   "SELECT tenant_id, sha256(c_txt) AS client_hash, s_txt AS product_code, q_val AS quantity, "
                   "CAST(p_val AS DOUBLE) AS price, strftime(t_val, '%Y-%m-%d %H:%M:%S') AS order_date, "
                   "t_val AS transaction_date, within_cap FROM capped_c WHERE reject_reason IS NULL"))
def feed_capped(spark, sf_dir):
    """The whole feed, with a mark on the rows that one delivery of CAP rows takes."""
    marked = cleaning.mark_cap(td.dirty_feed(spark, sf_dir), CAP, _CAP_ORDER)
    clean = cleaning.clean_feed(marked, keep=(*common.CLEAN_KEEP, "within_cap"))
    return clean.select("tenant_id", "client_hash", "product_code", "quantity",
                        F.col("price").cast("double").alias("price"), "order_date", "transaction_date", "within_cap")


@query("feed_count", covers="A2",
       sql=S.with_(S.DIRTY_FEED, "SELECT count(*) AS rows FROM dirty"))
def feed_count(spark, sf_dir):
    return cleaning.source_count(td.dirty_feed(spark, sf_dir))


@query("feed_keys", covers="D10",
       sql=S.with_(_DIRTY_CLEAN, "SELECT DISTINCT tenant_id, client_hash FROM clean"))
def feed_keys(spark, sf_dir):
    return cleaning.batch_keys(common.clean_dirty_feed(spark, sf_dir), ["tenant_id", "client_hash"])


@query("feed_union", covers="A5 E8",
       sql=S.with_(S.FEED,
                   "SELECT tenant_id, client, sku, brand, qty, CAST(price AS DOUBLE) AS price, "
                   "transaction_date FROM feed WHERE l_orderkey % 3 = 0 UNION ALL "
                   "SELECT tenant_id, client, sku, NULL AS brand, qty, CAST(price AS DOUBLE), "
                   "transaction_date FROM feed WHERE l_orderkey % 3 = 1 UNION ALL "
                   "SELECT tenant_id, client, sku, brand, qty, CAST(price AS DOUBLE), "
                   "transaction_date FROM feed WHERE l_orderkey % 3 = 2"))
def feed_union(spark, sf_dir):
    f = td.feed(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    cols = ["tenant_id", "client", "sku", "brand", "qty", "price", "transaction_date"]
    sheet_a = td.batch_of(f, 0).select(*cols)
    sheet_b = td.batch_of(f, 1).select(*[c for c in cols if c != "brand"])      # no brand column
    sheet_c = td.batch_of(f, 2).select(*reversed(cols))                          # other order
    return cleaning.union_feeds([sheet_a, sheet_b, sheet_c])


def _workbook_sql() -> str:
    rows = """
wb AS (
  SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL
              ELSE CAST(regexp_extract(client, '(\\d+)$', 1) AS DOUBLE) END AS "Customer ID",
         CAST(split_part(sku, '-', 2) AS BIGINT) AS "StockCode",
         CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS "Price",
         CASE WHEN l_orderkey % 31 = 0 THEN 'x' WHEN l_orderkey % 37 = 0 THEN '2.5'
              ELSE CAST(qty AS VARCHAR) END AS "Quantity",
         transaction_date AS "InvoiceDate", l_orderkey, l_linenumber
  FROM feed),
wb_c AS (
  SELECT CAST(CAST("Customer ID" AS BIGINT) AS VARCHAR) AS "Customer ID",
         CAST("StockCode" AS VARCHAR) AS "StockCode",
         coalesce(TRY_CAST("Price" AS DOUBLE), 0.0) AS "Price",
         coalesce(CAST(trunc(TRY_CAST("Quantity" AS DOUBLE)) AS INTEGER), 0) AS "Quantity",
         "InvoiceDate", l_orderkey, l_linenumber
  FROM wb WHERE "Customer ID" IS NOT NULL)"""
    return S.with_(S.FEED + "," + rows,
                   'SELECT "Customer ID", "StockCode", "Price", "Quantity", "InvoiceDate" FROM wb_c')


@query("workbook_coerce", covers="B9", sql=_workbook_sql())
def workbook_coerce(spark, sf_dir):
    c = cleaning.coerce_workbook(td.workbook_rows(spark, sf_dir))
    return c.select("Customer ID", "StockCode", "Price", "Quantity", "InvoiceDate")
