"""Source-schema shapes (C12-C15): a flat feed normalised into the 4-, 2- and
5-table layouts of the three source databases, and each layout flattened back
into the 5-column feed (client, sku, quantity, price, transaction_date).

Identifiers are natural keys (client text, sku) plus one row id per feed row
for headers and lines; every table keeps ``tenant_id`` (one source per tenant).
Dimension inserts that "do nothing on conflict" keep the first row in arrival
order (``min_by`` over the sequence columns).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = "tenant_id"


def _with_row_id(feed: DataFrame) -> DataFrame:
    """One id per feed row, materialised once (reliable checkpoint in the shared
    checkpoint folder): ``monotonically_increasing_id`` depends on row order, so
    headers and lines must read the same written ids, also after a task retry."""
    from shopsight.session import checkpoint_dir
    checkpoint_dir(feed.sparkSession)
    return feed.withColumn("row_id", F.monotonically_increasing_id()).checkpoint()


def _first_price(feed: DataFrame, seq: Sequence[str]) -> DataFrame:
    return feed.groupBy(K, "sku").agg(F.min_by("price", F.struct(*[F.col(c) for c in seq])).alias("price"))


def to_schema_4(feed: DataFrame, seq: Sequence[str]) -> dict:
    """customers(id, f_name), products(id, sku, price: first wins), one order per feed row
    (id, c_id, d_date) and its line (id, o_id, p_id, qty)."""
    f = _with_row_id(feed)
    custs = f.select(K, F.col("client").alias("id"), F.col("client").alias("f_name")).distinct()
    prods = _first_price(f, seq).select(K, F.col("sku").alias("id"), "sku", "price")
    orders = f.select(K, F.col("row_id").alias("id"), F.col("client").alias("c_id"),
                      F.col("transaction_date").alias("d_date"))
    items = f.select(K, F.col("row_id").alias("id"), F.col("row_id").alias("o_id"),
                     F.col("sku").alias("p_id"), F.col("qty"))
    return {"pg_custs": custs, "pg_prods": prods, "pg_orders": orders, "pg_items": items}


def flatten_4(t: dict) -> DataFrame:
    i, o, c, p = t["pg_items"], t["pg_orders"], t["pg_custs"], t["pg_prods"]
    j = (i.join(o.withColumnRenamed("id", "o_id"), [K, "o_id"])
          .join(c.withColumnRenamed("id", "c_id"), [K, "c_id"])
          .join(p.withColumnRenamed("id", "p_id"), [K, "p_id"]))
    return j.select(K, F.col("f_name").alias("client"), "sku", "qty", "price",
                    F.col("d_date").alias("transaction_date"))


def to_schema_2(feed: DataFrame) -> dict:
    """clients(uid, login) and a denormalised sales table with the row's own price
    (quantity is not kept by this layout)."""
    f = _with_row_id(feed)
    clients = f.select(K, F.col("client").alias("uid"), F.col("client").alias("login")).distinct()
    sales = f.select(K, F.col("row_id").alias("sid"), F.col("client").alias("client_id"),
                     F.col("sku").alias("item_sku"), F.col("price").alias("item_price"),
                     F.col("transaction_date").alias("sale_dt"))
    return {"my_clients": clients, "my_sales_flat": sales}


def flatten_2(t: dict) -> DataFrame:
    j = t["my_sales_flat"].join(t["my_clients"].withColumnRenamed("uid", "client_id"), [K, "client_id"])
    return j.select(K, F.col("login").alias("client"), F.col("item_sku").alias("sku"),
                    F.lit(1).alias("qty"), F.col("item_price").alias("price"),
                    F.col("sale_dt").alias("transaction_date"))


def to_schema_5(feed: DataFrame, seq: Sequence[str]) -> dict:
    """base(BID, InternalCode), contact(CID, BID, RealName 'Client_<code>'),
    catalog(PID, Art, Val: first wins), header(HID, BID, DocDate), lines(LID, HID, PID, Qty)."""
    f = _with_row_id(feed)
    base = f.select(K, F.col("client").alias("BID"), F.col("client").alias("InternalCode")).distinct()
    contact = base.select(K, F.col("BID").alias("CID"), "BID",
                          F.concat(F.lit("Client_"), F.col("InternalCode")).alias("RealName"))
    catalog = _first_price(f, seq).select(K, F.col("sku").alias("PID"), F.col("sku").alias("Art"),
                                          F.col("price").alias("Val"))
    header = f.select(K, F.col("row_id").alias("HID"), F.col("client").alias("BID"),
                      F.col("transaction_date").alias("DocDate"))
    lines = f.select(K, F.col("row_id").alias("LID"), F.col("row_id").alias("HID"),
                     F.col("sku").alias("PID"), F.col("qty").alias("Qty"))
    return {"MS_Base": base, "MS_Contact": contact, "MS_Catalog": catalog,
            "MS_Header": header, "MS_Lines": lines}


def flatten_5(t: dict) -> DataFrame:
    j = (t["MS_Lines"].join(t["MS_Header"], [K, "HID"])
                      .join(t["MS_Base"], [K, "BID"])
                      .join(t["MS_Catalog"], [K, "PID"]))
    return j.select(K, F.col("InternalCode").alias("client"), F.col("Art").alias("sku"),
                    F.col("Qty").alias("qty"), F.col("Val").alias("price"),
                    F.col("DocDate").alias("transaction_date"))
