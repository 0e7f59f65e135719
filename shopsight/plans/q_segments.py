"""Segmentation queries.

The oracle-checked queries label customers with the nearest of three fixed
centroids in the standardised R/F/M space, so labels are exact in both engines;
the fitted K-Means queries are checked on rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.operators import rfm
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query

# Fixed centroids (recency, frequency, monetary) in standardised units.
CENTROIDS = [(-0.8, 0.9, 1.0), (0.0, 0.0, 0.0), (1.0, -0.7, -0.6)]
WEIGHTS = {"recency": 1.0, "frequency": 1.5, "monetary": 1.0}
FEATS = rfm.FEATURES


# --- Spark side --------------------------------------------------------------------

def assigned(spark, sf_dir, weights=None, feats=None):
    z = common.rfm_scaled(spark, sf_dir, weights, feats)
    return rfm.assign_clusters(z, CENTROIDS)


def summary_of(a):
    return rfm.cluster_summary(a.select("tenant_id", "cluster_id", *[F.col(f"raw_{c}").alias(c) for c in FEATS]))


def scores_of(a):
    return rfm.silhouette(a).join(rfm.davies_bouldin(a), "tenant_id")


# --- SQL side ------------------------------------------------------------------------

def seg_sql(p: str, weights: dict | None = None) -> str:
    """CTEs ``{p}asg`` (labels), ``{p}sil`` (silhouette) and ``{p}db`` (Davies-Bouldin)."""
    w = weights or {}
    feat = ", ".join(f"{c} * {float(w.get(c, 1.0))} AS {c}" for c in FEATS)
    dist = [" + ".join(f"({c} - {v}) * ({c} - {v})" for c, v in zip(FEATS, cen)) for cen in CENTROIDS]
    label = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    xx = " + ".join(f"a.{c} * a.{c}" for c in FEATS)
    dot = " + ".join(f"a.{c} * c.s_{c}" for c in FEATS)
    dd = " + ".join(f"(a.{c} - c.m_{c}) * (a.{c} - c.m_{c})" for c in FEATS)
    cd = " + ".join(f"(i.m_{c} - j.m_{c}) * (i.m_{c} - j.m_{c})" for c in FEATS)
    return f""",
{p}w AS (SELECT tenant_id, buyer_id, raw_recency, raw_frequency, raw_monetary, {feat} FROM rfm_z),
{p}d AS (SELECT *, {dist[0]} AS d0, {dist[1]} AS d1, {dist[2]} AS d2 FROM {p}w),
{p}asg AS (SELECT * EXCLUDE (d0, d1, d2), {label} AS cluster_id FROM {p}d),
{p}cl AS (
  SELECT tenant_id, cluster_id, count(*) AS n,
         {", ".join(f"sum({c}) AS s_{c}" for c in FEATS)},
         sum({" + ".join(f"{c} * {c}" for c in FEATS)}) AS q
  FROM {p}asg GROUP BY tenant_id, cluster_id),
{p}tot AS (
  SELECT a.tenant_id, a.buyer_id, a.cluster_id AS own, c.cluster_id AS other, c.n,
         greatest(0.0, c.n * ({xx}) - 2 * ({dot}) + c.q) AS tot
  FROM {p}asg a JOIN {p}cl c ON a.tenant_id = c.tenant_id),
{p}pt AS (
  SELECT tenant_id, buyer_id,
         max(CASE WHEN own = other THEN n END) AS n_own,
         max(CASE WHEN own = other THEN tot / greatest(n - 1, 1) END) AS a,
         min(CASE WHEN own <> other THEN tot / n END) AS b
  FROM {p}tot GROUP BY tenant_id, buyer_id),
{p}sil AS (
  SELECT p.tenant_id,
         CASE WHEN k.n_clusters > 1 THEN {S.rnd('''avg(CASE WHEN n_own <= 1 THEN 0.0
                                                    WHEN greatest(a, b) = 0 THEN 0.0
                                                    ELSE (b - a) / greatest(a, b) END)''', 4)} END
           AS silhouette
  FROM {p}pt p JOIN (SELECT tenant_id, count(*) AS n_clusters FROM {p}cl GROUP BY tenant_id) k
    ON p.tenant_id = k.tenant_id
  GROUP BY p.tenant_id, k.n_clusters),
{p}cen AS (
  SELECT tenant_id, cluster_id, {", ".join(f"avg({c}) AS m_{c}" for c in FEATS)}
  FROM {p}asg GROUP BY tenant_id, cluster_id),
{p}disp AS (
  SELECT a.tenant_id, a.cluster_id, avg(sqrt({dd})) AS s
  FROM {p}asg a JOIN {p}cen c ON a.tenant_id = c.tenant_id AND a.cluster_id = c.cluster_id
  GROUP BY a.tenant_id, a.cluster_id),
{p}cc AS (SELECT c.*, d.s FROM {p}cen c JOIN {p}disp d
            ON c.tenant_id = d.tenant_id AND c.cluster_id = d.cluster_id),
{p}pair AS (
  SELECT i.tenant_id, i.cluster_id,
         max(CASE WHEN sqrt({cd}) = 0 THEN 0.0 ELSE (i.s + j.s) / sqrt({cd}) END) AS r
  FROM {p}cc i JOIN {p}cc j ON i.tenant_id = j.tenant_id AND i.cluster_id <> j.cluster_id
  GROUP BY i.tenant_id, i.cluster_id),
{p}db AS (SELECT tenant_id, {S.rnd('sum(r) / count(*)', 4)} AS davies_bouldin
          FROM {p}pair GROUP BY tenant_id)"""


def exact_mean_sql(col: str, digits: int = 2, scale: int = 4) -> str:
    t = f"CAST(sum(CAST(round(CAST({col} AS DOUBLE) * {10 ** scale}) AS HUGEINT)) AS HUGEINT)"
    return (f"CAST(sign({t}) * ((abs({t}) * {2 * 10 ** digits} + count(*) * {10 ** scale}) "
            f"// (count(*) * {2 * 10 ** scale})) AS DOUBLE) / {10 ** digits}")


BASE = S.RFM_SCALED + seg_sql("b_")
BOTH = S.RFM_SCALED + seg_sql("b_") + seg_sql("w_", WEIGHTS)


# --- queries ---------------------------------------------------------------------------

@query("cluster_assign", covers="C11",
       sql=S.with_(BASE, "SELECT tenant_id, buyer_id, cluster_id FROM b_asg"))
def cluster_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("tenant_id", "buyer_id", "cluster_id")


@query("cluster_summary", covers="D7 F5",
       sql=S.with_(BASE, f"""SELECT tenant_id, cluster_id,
  {exact_mean_sql('raw_recency')} AS recency, {exact_mean_sql('raw_frequency')} AS frequency,
  {exact_mean_sql('raw_monetary')} AS monetary, count(*) AS customer_count
FROM b_asg GROUP BY tenant_id, cluster_id"""))
def cluster_summary(spark, sf_dir):
    return summary_of(assigned(spark, sf_dir))


@query("silhouette", covers="G5", sql=S.with_(BASE, "SELECT tenant_id, silhouette FROM b_sil"))
def silhouette(spark, sf_dir):
    return rfm.silhouette(assigned(spark, sf_dir))


@query("davies_bouldin", covers="G6", sql=S.with_(BASE, "SELECT tenant_id, davies_bouldin FROM b_db"))
def davies_bouldin(spark, sf_dir):
    return rfm.davies_bouldin(assigned(spark, sf_dir))


@query("model_compare", covers="G2 G7",
       sql=S.with_(BOTH, f"""SELECT s.tenant_id, s.silhouette AS base_silhouette,
  d.davies_bouldin AS base_davies_bouldin, ws.silhouette AS weighted_silhouette,
  wd.davies_bouldin AS weighted_davies_bouldin,
  {S.rnd('ws.silhouette - s.silhouette', 4)} AS silhouette_diff,
  {S.rnd('wd.davies_bouldin - d.davies_bouldin', 4)} AS davies_bouldin_diff
FROM b_sil s JOIN b_db d ON s.tenant_id = d.tenant_id
JOIN w_sil ws ON s.tenant_id = ws.tenant_id JOIN w_db wd ON s.tenant_id = wd.tenant_id"""))
def model_compare(spark, sf_dir):
    feats = common.rfm_features(spark, sf_dir)
    return rfm.compare_models(*[scores_of(assigned(spark, sf_dir, w, feats)) for w in (None, WEIGHTS)])


def _pca_sql() -> str:
    c = {(i, j): f"covar_pop({FEATS[i]}, {FEATS[j]})" for i in range(3) for j in range(i, 3)}
    cov = ", ".join(f"{v} AS c{i}{j}" for (i, j), v in c.items())
    return S.with_(S.RFM_SCALED + f""",
cov AS (SELECT tenant_id, {cov} FROM rfm_z GROUP BY tenant_id),
e1 AS (SELECT *, c01 * c01 + c12 * c12 + c02 * c02 AS p1, (c00 + c11 + c22) / 3 AS q FROM cov),
e2 AS (SELECT *, sqrt(((c00 - q) * (c00 - q) + (c11 - q) * (c11 - q) + (c22 - q) * (c22 - q) + 2 * p1) / 6)
                 AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE
         ((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12)
          - c01 * (c01 * (c22 - q) - c12 * c02)
          + c02 * (c01 * c12 - (c11 - q) * c02)) / (p * p * p) / 2 END AS r FROM e2),
e4 AS (SELECT *, acos(least(1.0, greatest(-1.0, r))) / 3 AS phi FROM e3),
e5 AS (SELECT tenant_id, c00 + c11 + c22 AS tr,
              q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, 3 * q AS s3 FROM e4),
eig AS (SELECT tenant_id, tr, l1, s3 - l1 - l3 AS l2, l3 FROM e5),
comp AS (
  SELECT tenant_id, 1 AS component, l1 / tr * 100 AS pct FROM eig
  UNION ALL SELECT tenant_id, 2, l2 / tr * 100 FROM eig
  UNION ALL SELECT tenant_id, 3, l3 / tr * 100 FROM eig)""", f"""
SELECT tenant_id, CAST(component AS INTEGER) AS component, {S.rnd('pct', 4)} AS explained_variance_pct,
       {S.rnd('sum(pct) OVER (PARTITION BY tenant_id ORDER BY component)', 4)} AS cumulative_pct
FROM comp""")


@query("pca_variance", covers="G10 E4", sql=_pca_sql())
def pca_variance(spark, sf_dir):
    return rfm.pca_variance(common.rfm_scaled(spark, sf_dir))


@query("kmeans_fit", covers="G3")
def kmeans_fit(spark, sf_dir):
    return rfm.kmeans_fit(common.rfm_scaled(spark, sf_dir), k=3)


@query("kmeans_checks", covers="G3",
       sql=S.with_(S.RFM_METRICS, """SELECT tenant_id, count(*) AS customers, true AS sizes_add_up,
  true AS centroids_are_means, true AS nearest, true AS converged FROM rfm GROUP BY tenant_id"""))
def kmeans_checks(spark, sf_dir):
    """What every converged fit must show, per tenant: sizes add up, centroids are their
    members' means (within the tolerance), each customer is at the nearest centroid."""
    z = common.rfm_scaled(spark, sf_dir)
    cents = rfm.kmeans_fit(z, k=3).checkpoint()
    a = rfm.assign_clusters(z, cents)
    near = a.join(cents.select("tenant_id", *[F.col(c).alias(f"o_{c}") for c in ("cluster_id", *rfm.FEATURES)]), "tenant_id")
    own = F.col("cluster_id") == F.col("o_cluster_id")
    d = sum(((F.col(c) - F.col(f"o_{c}")) ** 2 for c in rfm.FEATURES), F.lit(0.0))
    per = near.groupBy("tenant_id", "buyer_id").agg(F.min(d).alias("best"), F.min(F.when(own, d)).alias("own"))
    nearest = per.groupBy("tenant_id").agg(F.count("*").alias("customers"),
                                           F.bool_and(F.col("own") <= F.col("best") + 1e-9).alias("nearest"))
    means = a.groupBy("tenant_id", "cluster_id").agg(F.count("*").alias("m_n"), *[F.avg(c).alias(f"m_{c}") for c in rfm.FEATURES])
    off = F.greatest(*[F.abs(F.col(f"m_{c}") - F.col(c)) for c in rfm.FEATURES])
    fits = cents.join(means, ["tenant_id", "cluster_id"], "left").groupBy("tenant_id").agg(
        F.sum("size").alias("sizes"), F.bool_and(F.coalesce(off <= 0.02, F.lit(True))).alias("centroids_are_means"),
        F.bool_and("converged").alias("converged"))
    return nearest.join(fits, "tenant_id").select(
        "tenant_id", "customers", (F.col("sizes") == F.col("customers")).alias("sizes_add_up"),
        "centroids_are_means", "nearest", "converged")


@query("kmeans_sweep_range", covers="G4",
       sql=S.with_(S.RFM_METRICS, """SELECT tenant_id, CAST(k AS INTEGER) AS k, true AS in_range
FROM (SELECT tenant_id, count(*) AS n FROM rfm GROUP BY tenant_id), range(2, 10) t(k) WHERE k <= n - 1"""))
def kmeans_sweep_range(spark, sf_dir):
    """Every tenant is scored for every k it allows, with scores in their ranges."""
    s = kmeans_sweep(spark, sf_dir)
    fine = F.coalesce(F.col("silhouette").between(-1, 1), F.lit(True)) & F.coalesce(F.col("db_index") >= 0, F.lit(True))
    return s.select("tenant_id", "k", fine.alias("in_range"))


@query("kmeans_sweep", covers="G4")
def kmeans_sweep(spark, sf_dir):
    return rfm.kmeans_sweep(common.rfm_scaled(spark, sf_dir), ks=range(2, 10))
