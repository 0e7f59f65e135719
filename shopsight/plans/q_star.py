"""Star-schema upkeep queries (C1-C8, L2, L3): the clean dirty feed loaded in
three batches (``l_orderkey % 3``), one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.operators import star as st
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.schemas import CUSTOMERS, ORDERS, PRODUCTS
from shopsight.session import staged
from shopsight.sources import testdata as td

_DIRTY_ITEMS = (S.DIRTY_FEED + "," + S.classify("dirty") + "," + S.clean("dirty") + ","
                + S.with_order_id("clean", "items"))


def loaded_star(spark, sf_dir, batches=(0, 1, 2), clean=None) -> st.Star:
    """Load the batches in order into an empty star (marker in event mode)."""
    clean = common.clean_dirty_feed(spark, sf_dir) if clean is None else clean
    s = st.Star.empty(spark, td.tenants(spark, sf_dir))
    for b in batches:
        s = st.load_batch(s, td.batch_of(clean, b), b, common.SEQ)
    return s


@query("tenant_resolve", covers="C1",
       sql=S.with_(S.FEED + """,
keyed AS (
  SELECT CASE WHEN l_orderkey % 53 = 0 THEN 'key_unknown' ELSE tenant_key END AS tenant_key FROM feed),
tn AS (SELECT n_nationkey AS tenant_id, 'key_' || CAST(n_nationkey AS VARCHAR) AS tenant_key FROM nation)""",
                   """SELECT k.tenant_key, t.tenant_id, count(*) AS n_rows, 'accepted' AS status
FROM keyed k JOIN tn t ON k.tenant_key = t.tenant_key GROUP BY k.tenant_key, t.tenant_id
UNION ALL
SELECT k.tenant_key, CAST(NULL AS INTEGER) AS tenant_id, count(*) AS n_rows, 'rejected' AS status
FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM tn t WHERE t.tenant_key = k.tenant_key)
GROUP BY k.tenant_key"""))
def tenant_resolve(spark, sf_dir):
    acc, rej = st.resolve_tenant(td.keyed_feed(spark, sf_dir), td.tenants(spark, sf_dir))
    a = (acc.groupBy("tenant_key", "tenant_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("status", F.lit("accepted")))
    r = (rej.groupBy("tenant_key").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("tenant_id", F.lit(None).cast("int")).withColumn("status", F.lit("rejected")))
    return a.unionByName(r)


@query("customers_upsert", covers="C2",
       sql=S.with_(_DIRTY_ITEMS, "SELECT DISTINCT tenant_id, client_hash AS customer_hash FROM items"))
def customers_upsert(spark, sf_dir):
    clean = common.clean_dirty_feed(spark, sf_dir)
    cur = spark.createDataFrame([], CUSTOMERS)
    for b in range(td.N_BATCHES):
        cur = st.upsert_customers(cur, td.batch_of(clean, b))
    return cur


@query("products_upsert", covers="C3",
       sql=S.with_(_DIRTY_ITEMS, """
SELECT tenant_id, product_code, CAST(price AS DOUBLE) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, product_code
    ORDER BY l_orderkey % 3 DESC, transaction_date DESC, l_orderkey DESC, l_linenumber DESC,
             price DESC) AS rn
  FROM items) WHERE rn = 1"""))
def products_upsert(spark, sf_dir):
    clean = common.clean_dirty_feed(spark, sf_dir)
    cur = spark.createDataFrame([], PRODUCTS)
    for b in range(td.N_BATCHES):
        cur = st.upsert_products(cur, td.batch_of(clean, b), common.SEQ)
    return cur.withColumn("price", F.col("price").cast("double"))


@query("orders_upsert", covers="C4 C5 C6",
       sql=S.with_(_DIRTY_ITEMS, """
SELECT DISTINCT order_id, tenant_id, client_hash AS customer_hash, transaction_date,
       'ORD-' || upper(substr(order_id, 1, 8)) AS order_number
FROM items"""))
def orders_upsert(spark, sf_dir):
    clean = st.with_order_id(common.clean_dirty_feed(spark, sf_dir))
    cur = spark.createDataFrame([], ORDERS)
    for b in range(td.N_BATCHES):
        # later batches look these headers up again
        cur = st.upsert_orders(cur, staged(st.batch_orders(td.batch_of(clean, b)), "batch-orders"))
    return cur


_ITEM_COLS = ("order_id, tenant_id, product_code, quantity, CAST(price AS DOUBLE) AS price, "
              "client_hash AS customer_hash, transaction_date, CAST(l_orderkey % 3 AS BIGINT) AS batch_id")


def _items_out(df):
    return df.withColumn("price", F.col("price").cast("double"))


ITEMS_SQL = S.with_(_DIRTY_ITEMS, f"SELECT {_ITEM_COLS} FROM items")


@query("items_append", covers="C7", sql=ITEMS_SQL)
def items_append(spark, sf_dir):
    return _items_out(loaded_star(spark, sf_dir).order_items)


@query("items_replay", covers="L3", sql=ITEMS_SQL)
def items_replay(spark, sf_dir):
    # batch 1 is delivered twice; the second delivery replaces the first
    return _items_out(loaded_star(spark, sf_dir, batches=(0, 1, 1, 2)).order_items)


@query("items_known_only", covers="C7",
       sql=S.with_(_DIRTY_ITEMS, f"""SELECT {_ITEM_COLS} FROM items
WHERE substr(client_hash, 1, 1) < '8' AND NOT contains(product_code, '7')"""))
def items_known_only(spark, sf_dir):
    """Line items whose customer or product is unknown are skipped."""
    # lines, customers and products are read from one copy of the clean records
    s = loaded_star(spark, sf_dir, clean=staged(common.clean_dirty_feed(spark, sf_dir), "clean-feed"))
    customers = s.customers.filter(F.substring("customer_hash", 1, 1) < "8")
    products = s.products.filter(~F.contains("product_code", F.lit("7")))
    return _items_out(st.append_items(None, s.order_items, 0, customers, products))


@query("sync_marker", covers="C8 L2",
       sql=S.with_(_DIRTY_ITEMS, """
SELECT n.n_nationkey AS tenant_id, 'key_' || CAST(n.n_nationkey AS VARCHAR) AS tenant_key,
       m.last_sync_date
FROM nation n LEFT JOIN (SELECT tenant_id, max(transaction_date) AS last_sync_date
                         FROM items GROUP BY tenant_id) m ON n.n_nationkey = m.tenant_id"""))
def sync_marker(spark, sf_dir):
    return loaded_star(spark, sf_dir).tenants.select("tenant_id", "tenant_key", "last_sync_date")
