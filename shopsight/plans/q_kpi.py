"""KPI and RFM-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.functions.scalar import compact_currency
from shopsight.operators import cleaning, kpi, rfm
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query

ROUND_Z = 6
WEIGHTS = {"recency": 1.0, "frequency": 1.5, "monetary": 1.0}

_KPI_SQL = """
kpi AS (
  SELECT tenant_id,
         CAST(coalesce(sum(CAST(quantity * price AS DECIMAL(38,4))), 0) AS DOUBLE) AS total_revenue,
         count(DISTINCT client_hash) AS total_customers
  FROM clean GROUP BY tenant_id),
kpi2 AS (
  SELECT *, CASE WHEN total_customers > 0 THEN total_revenue / total_customers ELSE 0.0 END
            AS avg_revenue_per_customer
  FROM kpi)"""


def compact_sql(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL OR isnan({v}) THEN '0.00'
        WHEN {v} >= 1e6 THEN CAST(CAST({S.rnd(f"{v} / 1e6", 2)} AS DECIMAL(38,2)) AS VARCHAR) || 'M'
        WHEN {v} >= 1e3 THEN CAST(CAST({S.rnd(f"{v} / 1e3", 1)} AS DECIMAL(38,1)) AS VARCHAR) || 'K'
        ELSE CAST(CAST({S.rnd(v, 2)} AS DECIMAL(38,2)) AS VARCHAR) END"""


@query("kpis_by_tenant", covers="D1 D2 D3",
       sql=S.with_(S.CLEAN_FEED + "," + _KPI_SQL, "SELECT * FROM kpi2"))
def kpis_by_tenant(spark, sf_dir):
    star = common.full_star(spark, sf_dir)
    return kpi.kpis(star.order_items, tenants=star.tenants)


# Every 5th nation has no items here, so that it shows as zeros.
@query("kpis_without_items", covers="D1 D2",
       sql=S.with_(S.CLEAN_FEED + "," + _KPI_SQL, """SELECT CAST(n_nationkey AS INTEGER) AS tenant_id,
  CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE coalesce(total_revenue, 0.0) END AS total_revenue,
  CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE coalesce(total_customers, 0) END AS total_customers,
  CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE coalesce(avg_revenue_per_customer, 0.0) END AS avg_revenue_per_customer
FROM nation LEFT JOIN kpi2 ON tenant_id = n_nationkey"""))
def kpis_without_items(spark, sf_dir):
    star = common.full_star(spark, sf_dir)
    return kpi.kpis(star.order_items.filter(F.col("tenant_id") % 5 != 0), tenants=star.tenants)


@query("kpi_display", covers="F1 D2",
       sql=S.with_(S.CLEAN_FEED + "," + _KPI_SQL,
                   f"SELECT tenant_id, {compact_sql('total_revenue')} AS revenue_display, "
                   f"{compact_sql('avg_revenue_per_customer')} AS avg_check_display FROM kpi2"))
def kpi_display(spark, sf_dir):
    k = kpis_by_tenant(spark, sf_dir)
    return k.select("tenant_id", compact_currency("total_revenue").alias("revenue_display"),
                    compact_currency("avg_revenue_per_customer").alias("avg_check_display"))


@query("rfm_metrics", covers="D4 A7 C9",
       sql=S.with_(S.RFM_METRICS, "SELECT * FROM rfm"))
def rfm_metrics(spark, sf_dir):
    return common.rfm_metrics(spark, sf_dir)


@query("rfm_recency", covers="E3",
       sql=S.with_(S.RFM_RECENCY,
                   "SELECT tenant_id, buyer_id, last_order_date, recency, frequency, monetary FROM rfm_r"))
def rfm_recency(spark, sf_dir):
    return common.rfm_features(spark, sf_dir).select(
        "tenant_id", "buyer_id", "last_order_date", "recency", "frequency", "monetary")


def _round_features(df, digits=ROUND_Z):
    return df.select("tenant_id", "buyer_id",
                     *[F.round(c, digits).alias(c) for c in rfm.FEATURES])


@query("rfm_scaled", covers="G1",
       sql=S.with_(S.RFM_SCALED,
                   f"SELECT tenant_id, buyer_id, {S.rnd('recency', ROUND_Z)} AS recency, "
                   f"{S.rnd('frequency', ROUND_Z)} AS frequency, {S.rnd('monetary', ROUND_Z)} AS monetary "
                   "FROM rfm_z"))
def rfm_scaled(spark, sf_dir):
    return _round_features(common.rfm_scaled(spark, sf_dir))


@query("rfm_weighted", covers="G2",
       sql=S.with_(S.RFM_SCALED,
                   "SELECT tenant_id, buyer_id, "
                   + ", ".join(f"{S.rnd(f'{c} * {w}', ROUND_Z)} AS {c}" for c, w in WEIGHTS.items())
                   + " FROM rfm_z"))
def rfm_weighted(spark, sf_dir):
    return _round_features(common.rfm_scaled(spark, sf_dir, WEIGHTS))


def _corr_sql() -> str:
    feats = rfm.FEATURES
    stats = ", ".join(
        [f"stddev_pop({c}) AS s_{c}" for c in feats]
        + [f"covar_pop({a}, {b}) AS c_{a}_{b}" for a in feats for b in feats])
    cells = []
    for a in feats:
        for b in feats:
            cells.append(
                f"SELECT tenant_id, '{a}' AS feature_a, '{b}' AS feature_b, "
                f"CASE WHEN s_{a} * s_{b} = 0 OR s_{a} IS NULL OR s_{b} IS NULL THEN 0.0 "
                f"ELSE {S.rnd(f'c_{a}_{b} / (s_{a} * s_{b})', 3)} END AS r FROM corr_stats")
    return S.with_(S.RFM_RECENCY + f",\ncorr_stats AS (SELECT tenant_id, {stats} FROM rfm_r GROUP BY tenant_id)",
                   "\nUNION ALL\n".join(cells))


@query("rfm_correlation", covers="D8", sql=_corr_sql())
def rfm_correlation(spark, sf_dir):
    return rfm.correlation_matrix(common.rfm_features(spark, sf_dir))


MIN_CUSTOMERS = 10


@query("tenant_guard", covers="B16",
       sql=S.with_(S.RFM_METRICS, f"""SELECT tenant_id, count(*) AS n_customers FROM rfm
GROUP BY tenant_id HAVING count(*) >= {MIN_CUSTOMERS}"""))
def tenant_guard(spark, sf_dir):
    """Tenants with enough customers to be segmented, and their customer counts."""
    kept = cleaning.tenants_with_min(common.rfm_metrics(spark, sf_dir), ["tenant_id"], MIN_CUSTOMERS)
    return kept.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_customers"))
