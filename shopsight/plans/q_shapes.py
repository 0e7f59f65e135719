"""Source-shape queries (C12-C15): normalise the feed, flatten it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.operators import shapes
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.sources import testdata as td

_OUT = ("tenant_id", "client", "sku", "qty", "price", "transaction_date")

_FIRST = S.FEED + """,
firstp AS (
  SELECT tenant_id, sku, price AS first_price FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, sku
              ORDER BY transaction_date, l_orderkey, l_linenumber, price) AS rn FROM feed)
  WHERE rn = 1)"""


def _out(df):
    return df.select(*_OUT).withColumn("price", F.col("price").cast("double"))


@query("shape4_flat", covers="C12 C15",
       sql=S.with_(_FIRST, """SELECT f.tenant_id, f.client, f.sku, f.qty,
  CAST(p.first_price AS DOUBLE) AS price, f.transaction_date
FROM feed f JOIN firstp p ON f.tenant_id = p.tenant_id AND f.sku = p.sku"""))
def shape4_flat(spark, sf_dir):
    return _out(shapes.flatten_4(shapes.to_schema_4(td.feed(spark, sf_dir), common.SEQ)))


@query("shape2_flat", covers="C13 C15",
       sql=S.with_(S.FEED, """SELECT tenant_id, client, sku, 1 AS qty, CAST(price AS DOUBLE) AS price,
  transaction_date FROM feed"""))
def shape2_flat(spark, sf_dir):
    return _out(shapes.flatten_2(shapes.to_schema_2(td.feed(spark, sf_dir))))


@query("shape5_flat", covers="C14 C15",
       sql=S.with_(_FIRST, """SELECT f.tenant_id, f.client, f.sku, f.qty,
  CAST(p.first_price AS DOUBLE) AS price, f.transaction_date
FROM feed f JOIN firstp p ON f.tenant_id = p.tenant_id AND f.sku = p.sku"""))
def shape5_flat(spark, sf_dir):
    return _out(shapes.flatten_5(shapes.to_schema_5(td.feed(spark, sf_dir), common.SEQ)))


@query("shape5_contacts", covers="C14",
       sql=S.with_(S.FEED, """SELECT DISTINCT tenant_id, client AS "BID", 'Client_' || client AS "RealName"
FROM feed"""))
def shape5_contacts(spark, sf_dir):
    t = shapes.to_schema_5(td.feed(spark, sf_dir), common.SEQ)
    return t["MS_Contact"].select("tenant_id", "BID", "RealName")
