"""Report queries.

The report log stand-in comes from ``events`` (tenant = user_id % 5, type =
event_type, created_at = ts); RFM and basket documents are built from the
segment and rule queries, written as JSON and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP
from shopsight.operators import basket as bk
from shopsight.operators import reports as rp
from shopsight.operators import rfm
from shopsight.plans import common, q_basket, q_segments
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.session import scratch_path, staged
from shopsight.sources import testdata as td

REPORT_TS = "2024-06-01 00:00:00"
KEEP = 3

_EV = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS report_id, CAST(user_id % 5 AS INTEGER) AS tenant_id,
         event_type AS report_type, value, ts AS created_at
  FROM events),
ev_r AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, report_type
                               ORDER BY created_at DESC, report_id DESC) AS rn
  FROM ev)"""


@query("report_retention", covers="E1",
       sql=S.with_(_EV, f"SELECT tenant_id, report_type, report_id, created_at FROM ev_r WHERE rn <= {KEEP}"))
def report_retention(spark, sf_dir):
    return rp.retain_latest(td.event_reports(spark, sf_dir), KEEP).select(
        "tenant_id", "report_type", "report_id", "created_at")


@query("report_latest", covers="A9 E2 F8",
       sql=S.with_(_EV, "SELECT tenant_id, report_type, report_id, created_at, value FROM ev_r WHERE rn = 1"))
def report_latest(spark, sf_dir):
    r = rp.latest_report(td.event_reports(spark, sf_dir))
    return r.select("tenant_id", "report_type", "report_id", "created_at",
                    F.from_json("payload", "event_id long, value double")["value"].alias("value"))


# --- RFM and basket documents ------------------------------------------------------------

def rfm_reports(spark, sf_dir, feats=None):
    """Headers of the RFM documents; all parts read the features once."""
    feats = common.rfm_features(spark, sf_dir) if feats is None else feats
    a = q_segments.assigned(spark, sf_dir, feats=feats)
    corr = rfm.correlation_matrix(feats)
    payload = rp.rfm_payload(q_segments.summary_of(a), q_segments.scores_of(a), None, corr, q_segments.WEIGHTS,
                             k=len(q_segments.CENTROIDS))
    return rp.report_rows(payload, rp.RFM_TYPE, F.lit(REPORT_TS))


def basket_reports(spark, sf_dir):
    """(headers, rule detail rows) of the basket report."""
    b = q_basket.stored_baskets(spark, sf_dir)
    rules = bk.rounded_rules(bk.association_rules(
        bk.frequent_itemsets(b, q_basket.MIN_SUPPORT), q_basket.MIN_CONFIDENCE))
    payload = rp.basket_payload(bk.basket_summary(b, rules), q_basket.MIN_SUPPORT,
                                q_basket.MIN_CONFIDENCE)
    headers = rp.report_rows(payload, rp.BASKET_TYPE, F.lit(REPORT_TS))
    return headers, rp.rule_rows(rules, headers)


_SUMMARY_SQL = q_segments.BASE + f""",
summ AS (
  SELECT tenant_id, cluster_id,
    {q_segments.exact_mean_sql('raw_recency')} AS recency,
    {q_segments.exact_mean_sql('raw_frequency')} AS frequency,
    {q_segments.exact_mean_sql('raw_monetary')} AS monetary, count(*) AS customer_count
  FROM b_asg GROUP BY tenant_id, cluster_id)"""


@query("report_segments", covers="H1 H3 F6 F8",
       sql=S.with_(_SUMMARY_SQL, """SELECT tenant_id, CAST(cluster_id AS VARCHAR) AS segment_key,
  'Cluster ' || CAST(cluster_id AS VARCHAR) AS buyer_id, recency, frequency, monetary,
  cluster_id AS cluster, customer_count FROM summ"""))
def report_segments(spark, sf_dir):
    s = rp.segments_table(rfm_reports(spark, sf_dir))
    return s.drop("report_id")


@query("report_rules", covers="H2 H4",
       sql=q_basket.with_rec(q_basket._mining_sql(), f"SELECT {q_basket._RULES_TXT} FROM rules"))
def report_rules(spark, sf_dir):
    r = rp.rules_table(*basket_reports(spark, sf_dir))
    return r.select("tenant_id", F.array_join("if_bought", ITEM_SEP).alias("antecedent"),
                    F.array_join("then_buy", ITEM_SEP).alias("consequent"),
                    "support", "confidence", "lift")


def _fixed(v: str, d: int) -> str:
    return f"CAST(CAST({S.rnd(v, d)} AS DECIMAL(38,{d})) AS VARCHAR)"


@query("report_bubbles", covers="H5",
       sql=S.with_(_SUMMARY_SQL, f"""SELECT tenant_id, cluster_id AS cluster, recency AS x, frequency AS y,
  monetary AS size,
  CASE WHEN max(monetary) OVER (PARTITION BY tenant_id) > 0
       THEN 2.0 * max(monetary) OVER (PARTITION BY tenant_id) / 6400 ELSE 1.0 END AS sizeref,
  'Сегмент ' || CAST(cluster_id AS VARCHAR) || ' (' || CAST(customer_count AS VARCHAR) || ' чол)' AS name,
  '<b>Кластер ' || CAST(cluster_id AS VARCHAR) || '</b><br>Клієнтів: ' || CAST(customer_count AS VARCHAR)
    || ' осіб<br>Середня давність: ' || {_fixed('recency', 1)} || ' дн.<br>Середня частота: '
    || {_fixed('frequency', 1)} || ' зам.<br>Середній чек: $' || {_fixed('monetary', 2)} AS hover
FROM summ"""))
def report_bubbles(spark, sf_dir):
    return rp.segment_bubbles(rp.segments_table(rfm_reports(spark, sf_dir)))


# --- exports (written to the scratch folder, read back) ----------------------------------------

@query("export_assignments", covers="A10",
       sql=S.with_(q_segments.BASE, "SELECT tenant_id, buyer_id AS id, cluster_id AS cid FROM b_asg"))
def export_assignments(spark, sf_dir):
    out = scratch_path(spark, "assignments_csv")
    feats = common.rfm_features(spark, sf_dir)
    headers = staged(rfm_reports(spark, sf_dir, feats), "report-headers")        # read by both sides of the export
    rows = rp.assignment_rows(q_segments.assigned(spark, sf_dir, feats=feats), headers)
    rp.export_assignments_csv(headers, rows, out)
    return spark.read.option("header", True).schema("id string, cid int").csv(out)


@query("export_rules", covers="A12",
       sql=q_basket.with_rec(q_basket._mining_sql(), f"""SELECT tenant_id,
  array_to_string(antecedent, ', ') AS "Antecedent", array_to_string(consequent, ', ') AS "Consequent",
  {_fixed('support', 4)} AS "Support", {_fixed('confidence', 4)} AS "Confidence",
  {_fixed('lift', 4)} AS "Lift" FROM rules"""))
def export_rules(spark, sf_dir):
    out = scratch_path(spark, "rules_csv")
    rp.export_rules_csv(q_basket.brand_rules(spark, sf_dir), out)
    return (spark.read.option("header", True).option("escape", '"')
            .schema("Antecedent string, Consequent string, Support string, Confidence string, Lift string")
            .csv(out))


@query("export_report_json", covers="A11",
       sql=S.with_(_EV, """SELECT tenant_id, CAST(report_id AS BIGINT) AS event_id, value
FROM ev_r WHERE rn = 1 AND report_type = 'purchase'"""))
def export_report_json(spark, sf_dir):
    out = scratch_path(spark, "report_json")
    schema = "event_id long, value double"
    rp.export_report_json(td.event_reports(spark, sf_dir), "purchase", schema, out)
    return spark.read.schema(schema).json(out)
