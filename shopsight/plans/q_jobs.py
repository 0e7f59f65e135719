"""Whole-job queries (J1-J4, L1-L3, A4, A13, B11): loads through the star store, the
streaming ingest, and the RFM / basket / nightly jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP
from shopsight.operators import basket as bk
from shopsight.operators import reports as rp
from shopsight.plans import common, jobs, q_basket, q_star
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.schemas import RFM_PAYLOAD
from shopsight.session import scratch_path
from shopsight.sources import testdata as td
from shopsight.sources.store import ReportStore, StarStore
from shopsight.sources.views import CustomerViews
from shopsight.streaming.ingest import ingest_stream

REPORT_TS = "2024-06-01 00:00:00"


def _items(star):
    return star.order_items.withColumn("price", F.col("price").cast("double"))


@query("load_star", covers="J4 A13 L3", sql=q_star.ITEMS_SQL)
def load_star(spark, sf_dir):
    """Dirty feed loaded in three batches through the Parquet store, batch 1 twice."""
    store = StarStore(scratch_path(spark, "star"))
    dirty = td.dirty_feed(spark, sf_dir)
    for b in (0, 1, 1, 2):
        jobs.load(td.batch_of(dirty, b), store, b, common.SEQ)
    return _items(store.snapshot(spark, td.tenants(spark, sf_dir)))


PRODUCTS_SQL = S.with_(q_star._DIRTY_ITEMS, """
SELECT tenant_id, product_code, CAST(price AS DOUBLE) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, product_code
    ORDER BY l_orderkey % 3 DESC, transaction_date DESC, l_orderkey DESC, l_linenumber DESC,
             price DESC) AS rn
  FROM items) WHERE rn = 1""")


@query("store_replay", covers="C3 L3 A13", sql=PRODUCTS_SQL)
def store_replay(spark, sf_dir):
    """Three batches, then batch 1 again: its rows are replaced and the last batch's prices stay."""
    store = StarStore(scratch_path(spark, "star"))
    dirty = td.dirty_feed(spark, sf_dir)
    for b in (0, 1, 2, 1):
        jobs.load(td.batch_of(dirty, b), store, b, common.SEQ)
    return store.snapshot(spark).products.withColumn("price", F.col("price").cast("double"))


@query("load_late_rows", covers="B12 L2", sql=S.with_(q_star._DIRTY_ITEMS, f"""
SELECT order_id, tenant_id, product_code, quantity, CAST(price AS DOUBLE) AS price, client_hash AS customer_hash,
  transaction_date, CAST(CASE WHEN transaction_date <= TIMESTAMP '{td.DELTA_MARKER}' AND NOT (l_orderkey % 11 = 0
    AND transaction_date > TIMESTAMP '{td.DELTA_MARKER}' - INTERVAL 365 DAY) THEN 0 ELSE 1 END AS BIGINT) AS batch_id
FROM items"""))
def load_late_rows(spark, sf_dir):
    """Rows up to the marker, but for every 11th order of the year before it, which is late; then
    a delta load of the whole source that reads a year of overlap: as one load of it all."""
    store = StarStore(scratch_path(spark, "star"))
    dirty = td.dirty_feed(spark, sf_dir)
    since = F.lit(td.DELTA_MARKER).cast("timestamp_ntz")
    at = F.col("transaction_date").cast("timestamp_ntz")
    late = (F.col("l_orderkey") % 11 == 0) & (at > since - F.expr("INTERVAL 365 days"))
    jobs.load(dirty.filter(~late & (at <= since)), store, 0, common.SEQ)
    jobs.load(dirty, store, 1, common.SEQ, mode="delta", marker=td.DELTA_MARKER, overlap="365 days")
    return _items(store.snapshot(spark, td.tenants(spark, sf_dir)))


def _followed(spark, sf_dir) -> CustomerViews:
    """Views that follow four deliveries; the first one of batch 1 brings the lines of batch 2, the
    last one puts it right."""
    store, views = StarStore(scratch_path(spark, "star")), CustomerViews(scratch_path(spark, "views"), "year")
    dirty = td.dirty_feed(spark, sf_dir)
    for batch, lines in ((0, 0), (1, 2), (2, 2), (1, 1)):
        jobs.load(td.batch_of(dirty, lines), store, batch, common.SEQ)
        views.refresh(spark, store, batch)
    return views


@query("customer_views", covers="D4 L3", sql=S.with_(q_star._DIRTY_ITEMS, """
SELECT tenant_id, client_hash AS buyer_id, max(transaction_date) AS last_order_date,
  count(DISTINCT order_id) AS frequency,
  CAST(sum(CAST(quantity * price AS DECIMAL(38,4))) AS DOUBLE) AS monetary
FROM items GROUP BY tenant_id, client_hash"""))
def customer_views(spark, sf_dir):
    """Customer metrics kept up to date by batch."""
    return _followed(spark, sf_dir).customer_metrics(spark)


@query("kpi_views", covers="D1 D2 L3", sql=S.with_(q_star._DIRTY_ITEMS + """,
sums AS (SELECT tenant_id, CAST(sum(CAST(quantity * price AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue,
  count(DISTINCT client_hash) AS total_customers FROM items GROUP BY tenant_id)""", """
SELECT n_nationkey AS tenant_id, coalesce(total_revenue, 0.0) AS total_revenue,
  coalesce(total_customers, 0) AS total_customers,
  CASE WHEN total_customers > 0 THEN total_revenue / total_customers ELSE 0.0 END AS avg_revenue_per_customer
FROM nation LEFT JOIN sums ON tenant_id = n_nationkey"""))
def kpi_views(spark, sf_dir):
    """KPIs of every tenant from the same views."""
    return _followed(spark, sf_dir).kpis(spark, td.tenants(spark, sf_dir))


TENANT = 7


@query("tenant_scope", covers="B11",
       sql=S.with_(q_star._DIRTY_ITEMS, f"SELECT {q_star._ITEM_COLS} FROM items WHERE tenant_id = {TENANT}"))
def tenant_scope(spark, sf_dir):
    """One tenant of the store: its bucket is read, nothing else."""
    store = StarStore(scratch_path(spark, "star"))
    dirty = td.dirty_feed(spark, sf_dir)
    for b in (0, 1, 2):
        jobs.load(td.batch_of(dirty, b), store, b, common.SEQ)
    return _items(store.snapshot(spark, td.tenants(spark, sf_dir), tenant_id=TENANT))


def _streamed(spark, sf_dir, to_feed, tenants=None) -> StarStore:
    """The order lines arrive in three deliveries of as many files as the table gives; after each
    the stream runs over what is new, a micro-batch each."""
    folder, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "stream_ckpt")
    store, lines = StarStore(scratch_path(spark, "stream_star")), td.table(spark, sf_dir, "lineitem")
    for b in range(td.N_BATCHES):
        td.batch_of(lines, b).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(lines.schema).parquet(folder)
        ingest_stream(stream, store, checkpoint, common.SEQ, to_feed=to_feed, tenants=tenants).awaitTermination()
    return store


@query("stream_ingest", covers="L1 A4", sql=S.with_(S.STAR_ITEMS, """SELECT order_id, tenant_id,
  product_code, quantity, CAST(price AS DOUBLE) AS price, client_hash AS customer_hash,
  transaction_date, CAST(l_orderkey % 3 AS BIGINT) AS batch_id FROM items"""))
def stream_ingest(spark, sf_dir):
    """Order lines streamed in three deliveries, a micro-batch each, enriched and stored."""
    store = _streamed(spark, sf_dir, lambda batch: td.feed_from_lines(spark, sf_dir, batch))
    return _items(store.snapshot(spark, td.tenants(spark, sf_dir)))


@query("stream_counters", covers="L1 B6 C1",
       sql=S.with_(S.DIRTY_FEED + "," + S.classify("dirty"), """
SELECT CAST(l_orderkey % 3 AS BIGINT) AS batch_id,
  count(*) FILTER (WHERE l_orderkey % 53 <> 0) AS processed,
  count(*) FILTER (WHERE l_orderkey % 53 <> 0 AND reject_reason IS NULL) AS sent,
  count(*) FILTER (WHERE l_orderkey % 53 <> 0 AND reject_reason IS NOT NULL) AS filtered,
  count(*) FILTER (WHERE l_orderkey % 53 = 0) AS unknown_key
FROM dirty_c GROUP BY 1"""))
def stream_counters(spark, sf_dir):
    """Counters of every micro-batch, from the pass that stored it; every 53rd order comes
    with an unknown integration key."""
    def keyed(batch):
        f = td.with_defects(td.feed_from_lines(spark, sf_dir, batch))
        bad = F.col("l_orderkey") % 53 == 0
        return f.withColumn("tenant_key", F.when(bad, F.lit(td.UNKNOWN_TENANT_KEY)).otherwise(F.col("tenant_key"))) \
            .drop("tenant_id")

    store = _streamed(spark, sf_dir, keyed, td.tenants(spark, sf_dir))
    return store.batches(spark).select("batch_id", "processed", "sent", "filtered", "unknown_key")


@query("run_rfm", covers="J1 H1 A8 G7",
       sql=S.with_(S.RFM_METRICS, """SELECT tenant_id, 'rfm_analysis' AS report_type,
  CAST(3 AS BIGINT) AS segments, count(*) AS customers, count(*) AS assignments,
  true AS compared FROM rfm GROUP BY tenant_id"""))
def run_rfm(spark, sf_dir):
    """Every tenant's report: its segments hold all customers, each customer has a label."""
    reports = ReportStore(scratch_path(spark, "reports"))
    jobs.run_rfm(common.full_star(spark, sf_dir), reports, created_at=REPORT_TS)
    doc = reports.headers(spark).withColumn("p", F.from_json("payload", RFM_PAYLOAD))
    doc = doc.select("tenant_id", "report_type", F.size("p.segments").cast("long").alias("segments"),
                     F.expr("aggregate(map_values(p.segments), 0L, (s, x) -> s + x.customer_count)").alias("customers"),
                     F.col("p.comparison").isNotNull().alias("compared"))
    labels = reports.details(spark, "assignments").groupBy("tenant_id").agg(F.count("*").alias("assignments"))
    return doc.join(labels, "tenant_id")


@query("run_basket", covers="J2 H2 A8",
       sql=q_basket.with_rec(q_basket._mining_sql(0.01, 0.5), f"SELECT {q_basket._RULES_TXT} FROM rules"))
def run_basket(spark, sf_dir):
    reports = ReportStore(scratch_path(spark, "reports"))
    jobs.run_basket(td.brand_transactions(spark, sf_dir), reports, min_support=0.01,
                    min_confidence=0.5, created_at=REPORT_TS)
    rows = reports.details(spark, "rules")
    return rows.select("tenant_id", F.array_join("if_bought", ITEM_SEP).alias("antecedent"),
                       F.array_join("then_buy", ITEM_SEP).alias("consequent"), "support", "confidence", "lift")


NIGHT_SUPPORT, NIGHT_CONFIDENCE = 0.01, 0.01
_NIGHT = """
cust AS (SELECT tenant_id, count(DISTINCT client) AS n FROM night GROUP BY tenant_id),
bi AS (SELECT DISTINCT tenant_id, client, transaction_date, brand FROM night),
ords AS (SELECT tenant_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, client, transaction_date FROM bi) GROUP BY tenant_id),
one AS (SELECT tenant_id, brand, count(*) AS c FROM bi GROUP BY ALL),
two AS (SELECT a.tenant_id, a.brand AS a, b.brand AS b, count(*) AS c FROM bi a JOIN bi b
        ON a.tenant_id = b.tenant_id AND a.client = b.client AND a.transaction_date = b.transaction_date
        AND a.brand <> b.brand GROUP BY ALL),
ruled AS (SELECT DISTINCT two.tenant_id FROM two JOIN ords USING (tenant_id) JOIN one
          ON one.tenant_id = two.tenant_id AND one.brand = two.a
          WHERE two.c::DOUBLE / ords.n >= %s AND two.c::DOUBLE / one.c >= %s),
st AS (
  SELECT CAST(n_nationkey AS INTEGER) AS tenant_id, 'rfm_analysis' AS report_type, coalesce(cust.n, 0) AS n,
         coalesce(cust.n, 0) >= 10 AS ok, 'fewer than 10 customers' AS few, 'no model' AS none
  FROM register AS nation LEFT JOIN cust ON cust.tenant_id = n_nationkey
  UNION ALL
  SELECT CAST(n_nationkey AS INTEGER), 'fp_growth_rules', coalesce(ords.n, 0),
         coalesce(ords.n, 0) >= 10 AND ruled.tenant_id IS NOT NULL, 'fewer than 10 orders',
         'no frequent itemset or no rule'
  FROM register AS nation LEFT JOIN ords ON ords.tenant_id = n_nationkey LEFT JOIN ruled ON ruled.tenant_id = n_nationkey)""" % (NIGHT_SUPPORT, NIGHT_CONFIDENCE)


def _night(spark, feed, tenants):
    """Status of all tenants of a nightly run after an earlier basket run, keeping one report."""
    store = StarStore(scratch_path(spark, "star"))
    jobs.load(feed, store, 0, common.SEQ)
    star = store.snapshot(spark, tenants)
    reports = ReportStore(scratch_path(spark, "reports"))
    jobs.run_basket(bk.transactions(star), reports, NIGHT_SUPPORT, NIGHT_CONFIDENCE, created_at="2024-05-01 00:00:00")
    status = jobs.run_all_tenants(star, reports, 1, NIGHT_SUPPORT, NIGHT_CONFIDENCE, created_at=REPORT_TS)
    left = reports.headers(spark).groupBy("tenant_id", "report_type").agg(F.count("*").alias("kept_reports"))
    return status.join(left, ["tenant_id", "report_type"], "left").withColumn(
        "kept_reports", F.coalesce("kept_reports", F.lit(0)))


# Copies of a few clients under tenants SMALL + n; tenants EMPTY + n are in the register only.
SMALL, EMPTY, FEW_CLIENTS = 100, 200, 200
_WHOLE = S.FEED + f""",
night AS (SELECT tenant_id, client, transaction_date, brand FROM feed
          UNION ALL
          SELECT {SMALL} + tenant_id, 'Copy of ' || client, transaction_date, brand FROM feed
          WHERE CAST(regexp_extract(client, '([0-9]+)$', 1) AS INTEGER) <= {FEW_CLIENTS}),
register AS (SELECT unnest([n_nationkey, {SMALL} + n_nationkey, {EMPTY} + n_nationkey]) AS n_nationkey FROM nation),
""" + _NIGHT


def whole_night(spark, sf_dir):
    """The whole feed with the small tenants' rows, and the register with small and empty tenants."""
    f = td.feed(spark, sf_dir).withColumn("sku", F.col("brand"))
    few = F.regexp_extract("client", r"([0-9]+)$", 1).cast("int") <= FEW_CLIENTS
    known, key = td.tenants(spark, sf_dir), F.concat(F.lit("key_"), F.col("tenant_id").cast("string"))
    small = (f.filter(few).withColumn("tenant_id", F.col("tenant_id") + SMALL).withColumn("tenant_key", key)
             .withColumn("client", F.concat(F.lit("Copy of "), "client")))
    more = [known.withColumn("tenant_id", F.col("tenant_id") + n).withColumn("tenant_key", key) for n in (SMALL, EMPTY)]
    return f.unionByName(small), known.unionByName(more[0]).unionByName(more[1])


@query("run_all_tenants_whole", covers="J3 E1 B16",
       sql=S.with_(_WHOLE, """SELECT tenant_id, report_type,
  CASE WHEN ok THEN 'done' ELSE 'skipped' END AS status,
  CASE WHEN ok THEN NULL WHEN n < 10 THEN few ELSE none END AS reason, n,
  CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS kept_reports FROM st"""))
def run_all_tenants_whole(spark, sf_dir):
    """The nightly run over every row of the feed, next to small tenants and tenants without data."""
    return _night(spark, *whole_night(spark, sf_dir))


def exported(spark, sf_dir):
    """RFM documents with the whole k sweep, as read back."""
    reports = ReportStore(scratch_path(spark, "reports"))
    headers, _ = jobs.run_rfm(common.full_star(spark, sf_dir), reports, created_at=REPORT_TS)
    out = scratch_path(spark, "report_json")
    rp.export_report_json(headers, rp.RFM_TYPE, RFM_PAYLOAD, out)
    return spark.read.schema(RFM_PAYLOAD).json(out)


@query("export_reports", covers="A11 H1",
       sql=S.with_(S.RFM_METRICS, """SELECT tenant_id, 'feature_weighting_fixed_k' AS strategy,
  CAST(3 AS INTEGER) AS optimized_k, 'squared_euclidean' AS silhouette_metric, count(*) AS customers
FROM rfm GROUP BY tenant_id"""))
def export_reports(spark, sf_dir):
    """The RFM documents of a job, exported as JSON lines per tenant and read back."""
    doc = exported(spark, sf_dir)
    return doc.select("tenant_id", "strategy", "performance.optimized_k", "performance.silhouette_metric",
                      F.expr("aggregate(map_values(segments), 0L, (s, x) -> s + x.customer_count)").alias("customers"))
