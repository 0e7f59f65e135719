"""Report documents, retention and read-back.

A report is one header row (report_id, tenant_id, report_type, payload JSON,
created_at).  The JSON holds only parts whose size is fixed by parameters
(k segments, 3x3 correlations, the k sweep, mining parameters and counts).
Parts that grow with the data -- customer assignments and association rules --
are detail tables keyed by ``report_id``; readers join them to the newest
header, so no tenant's rules or customers are ever gathered into one row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP, cluster_name, cluster_name_ua, fixed, segment_legend
from shopsight.schemas import BASKET_PAYLOAD, RFM_PAYLOAD

RFM_TYPE = "rfm_analysis"
BASKET_TYPE = "fp_growth_rules"
SILHOUETTE_METRIC = "squared_euclidean"      # linear in the customers; not the Euclidean score
RFM_STRATEGY = "feature_weighting_fixed_k"
BASKET_ALGORITHM = "FP-Growth"
GROUP = ("tenant_id", "report_type")


# --- E1 / E2 / A9: retention and newest report ------------------------------------

def _newest_first(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("report_id").desc())


def retain_latest(reports: DataFrame, keep: int = 3, keys: Sequence[str] = GROUP) -> DataFrame:
    """The ``keep`` newest reports per (tenant, type); older ones are dropped.

    ``row_number() <= keep`` lets Spark cut every group map-side before the
    shuffle, so a very large group never lands whole in one task.
    """
    return (reports.withColumn("__rn", F.row_number().over(_newest_first(keys)))
                   .filter(F.col("__rn") <= keep).drop("__rn"))


def latest_report(reports: DataFrame, report_type: str | None = None,
                  tenant_id: int | None = None, keys: Sequence[str] = GROUP) -> DataFrame:
    """Newest report per (tenant, type); an empty result means "not found"."""
    r = reports
    if report_type is not None:
        r = r.filter(F.col("report_type") == report_type)
    if tenant_id is not None:
        r = r.filter(F.col("tenant_id") == tenant_id)
    return retain_latest(r, 1, keys)


def report_rows(payloads: DataFrame, report_type: str, created_at: Column | None = None) -> DataFrame:
    """(tenant_id, payload) -> report rows with a deterministic id."""
    ts = created_at if created_at is not None else F.localtimestamp()
    r = payloads.select("tenant_id", F.lit(report_type).alias("report_type"), "payload",
                        ts.cast("timestamp_ntz").alias("created_at"))
    rid = F.sha2(F.concat_ws("|", F.col("tenant_id").cast("string"), F.col("report_type"),
                             F.col("created_at").cast("string"), F.sha2(F.col("payload"), 256)), 256)
    return r.withColumn("report_id", F.substring(rid, 1, 32)).select(
        "report_id", "tenant_id", "report_type", "payload", "created_at")


# --- H1: RFM document --------------------------------------------------------------------

def rfm_payload(summary: DataFrame, performance: DataFrame, sweep: DataFrame | None,
                correlation: DataFrame, weights: dict, k: int, comparison: DataFrame | None = None) -> DataFrame:
    """(tenant_id, payload) of the RFM report.

    summary: (tenant_id, cluster_id, recency, frequency, monetary, customer_count)
    performance: (tenant_id, silhouette, davies_bouldin)
    sweep: (tenant_id, k, silhouette, db_index); correlation: (tenant_id, feature_a, feature_b, r)
    Customer assignments are detail rows (``assignment_rows``), not part of the JSON.
    """
    seg = summary.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("cluster_id").cast("string"),
        F.struct(F.col("cluster_id").cast("int").alias("cluster_id"), "recency", "frequency",
                 "monetary", "customer_count")))).alias("segments"))
    rows = correlation.groupBy("tenant_id", "feature_a").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_b", "r"))).alias("__row"))
    corr = rows.groupBy("tenant_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_a", "__row"))).alias("correlation"))
    parts = seg.join(corr, "tenant_id").join(performance, "tenant_id", "left")
    if sweep is not None:
        hist = sweep.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct(
            F.col("k").cast("string"), F.struct("silhouette", "db_index")))).alias("tuning_history"))
        parts = parts.join(hist, "tenant_id", "left")
    else:
        parts = parts.withColumn("tuning_history", F.lit(None).cast(RFM_PAYLOAD["tuning_history"].dataType))
    parts = parts.withColumn("assignments", F.lit(None).cast(RFM_PAYLOAD["assignments"].dataType))
    if comparison is not None:
        scores = [c for c in comparison.columns if c != "tenant_id"]
        parts = parts.join(comparison.select("tenant_id", F.struct(*scores).alias("comparison")), "tenant_id", "left")
    else:
        parts = parts.withColumn("comparison", F.lit(None).cast(RFM_PAYLOAD["comparison"].dataType))
    w = F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(float(v)))])
    doc = F.struct(
        F.lit(RFM_STRATEGY).alias("strategy"), w.alias("weights"),
        F.struct(F.lit(k).alias("optimized_k"), F.col("silhouette"), F.lit(SILHOUETTE_METRIC).alias("silhouette_metric"),
                 F.col("davies_bouldin")).alias("performance"),
        "comparison", "tuning_history", "correlation", "segments", "assignments")
    return parts.select("tenant_id", F.to_json(doc).alias("payload"))


# --- H2: basket document --------------------------------------------------------------------

def basket_payload(summary: DataFrame, min_support: float, min_threshold: float) -> DataFrame:
    """(tenant_id, payload) of the basket report header: algorithm, parameters, counts.

    summary: (tenant_id, total_orders, rules_found).  The rules themselves are
    detail rows (``rule_rows``).
    """
    doc = F.struct(
        F.lit(BASKET_ALGORITHM).alias("algorithm"),
        F.struct(F.lit(float(min_support)).alias("min_support"),
                 F.lit(float(min_threshold)).alias("min_threshold")).alias("parameters"),
        F.struct("total_orders", "rules_found").alias("summary"))
    return summary.select("tenant_id", F.to_json(doc).alias("payload"))


def rule_rows(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Detail rows of a basket report: the tenant's rules tagged with the report id."""
    ids = headers.filter(F.col("report_type") == BASKET_TYPE).select("tenant_id", "report_id")
    return rules.join(ids, "tenant_id").select(
        "report_id", "tenant_id", F.col("antecedent").alias("if_bought"),
        F.col("consequent").alias("then_buy"), "support", "confidence", "lift")


def assignment_rows(assigned: DataFrame, headers: DataFrame) -> DataFrame:
    """Detail rows of an RFM report: (report_id, tenant_id, id, cid)."""
    ids = headers.filter(F.col("report_type") == RFM_TYPE).select("tenant_id", "report_id")
    return assigned.join(ids, "tenant_id").select(
        "report_id", "tenant_id", F.col("buyer_id").alias("id"), F.col("cluster_id").cast("int").alias("cid"))


# --- H3 / H4: typed rows back from the documents --------------------------------------------------

def segments_table(reports: DataFrame) -> DataFrame:
    """Newest RFM report per tenant -> one row per segment; missing numbers become 0."""
    r = latest_report(reports, RFM_TYPE).select(
        "tenant_id", "report_id", F.from_json("payload", RFM_PAYLOAD).alias("p"))
    e = r.select("tenant_id", "report_id", F.explode("p.segments").alias("segment_key", "s"))
    return e.select(
        "tenant_id", "report_id", "segment_key",
        cluster_name(F.coalesce(F.col("s.cluster_id"), F.lit(0))).alias("buyer_id"),
        F.coalesce(F.col("s.recency"), F.lit(0.0)).alias("recency"),
        F.coalesce(F.col("s.frequency"), F.lit(0.0)).alias("frequency"),
        F.coalesce(F.col("s.monetary"), F.lit(0.0)).alias("monetary"),
        F.coalesce(F.col("s.cluster_id"), F.lit(0)).alias("cluster"),
        F.coalesce(F.col("s.customer_count"), F.lit(0)).alias("customer_count"))


def rules_table(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Newest basket report per tenant -> its rules (rows of ``rule_rows``) with the
    header's parameters decoded from JSON."""
    r = latest_report(reports, BASKET_TYPE).select(
        "report_id", F.from_json("payload", BASKET_PAYLOAD).alias("p"))
    return rules.join(r.select("report_id", F.col("p.parameters.min_support").alias("min_support"),
                               F.col("p.parameters.min_threshold").alias("min_threshold")), "report_id")


def assignments_table(reports: DataFrame, assignments: DataFrame) -> DataFrame:
    """Newest RFM report per tenant -> its (id, cid) rows."""
    ids = latest_report(reports, RFM_TYPE).select("report_id")
    return assignments.join(ids, "report_id")


# --- H5: bubble chart data -----------------------------------------------------------------------

def segment_bubbles(segments: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """x = recency, y = frequency, bubble area = monetary, sizeref = 2*max/80^2 (1 if max <= 0)."""
    mx = F.max("monetary").over(Window.partitionBy(*keys))
    hover = F.concat(
        F.lit("<b>"), cluster_name_ua("cluster"), F.lit("</b><br>Клієнтів: "),
        F.col("customer_count").cast("string"), F.lit(" осіб<br>Середня давність: "),
        fixed("recency", 1), F.lit(" дн.<br>Середня частота: "), fixed("frequency", 1),
        F.lit(" зам.<br>Середній чек: $"), fixed("monetary", 2))
    return segments.select(
        *keys, "cluster", F.col("recency").alias("x"), F.col("frequency").alias("y"),
        F.col("monetary").alias("size"),
        F.when(mx > 0, 2.0 * mx / (80 ** 2)).otherwise(F.lit(1.0)).alias("sizeref"),
        segment_legend("cluster", "customer_count").alias("name"), hover.alias("hover"))


# --- A8 / A10-A12: sinks -----------------------------------------------------------------------

def save_report(reports: DataFrame, path: str) -> None:
    """Append reports, partitioned by tenant and type (partition pruning on read)."""
    reports.hint("rebalance", "tenant_id").write.mode("append").partitionBy("tenant_id", "report_type").parquet(path)


def compact_reports(spark, src: str, dst: str, keep: int = 3) -> DataFrame:
    """Retention as a rewrite: the kept reports go to a new folder (a path that is
    being read is never overwritten)."""
    kept = retain_latest(spark.read.parquet(src), keep)
    kept.hint("rebalance", "tenant_id").write.mode("overwrite").partitionBy("tenant_id", "report_type").parquet(dst)
    return spark.read.parquet(dst)


def export_assignments_csv(reports: DataFrame, assignments: DataFrame, out: str) -> None:
    """A10: ``id,cid`` CSV of the newest RFM report, one folder per tenant."""
    (assignments_table(reports, assignments).select("tenant_id", "id", "cid").hint("rebalance", "tenant_id")
     .write.mode("overwrite").partitionBy("tenant_id").option("header", True).csv(out))


def export_report_json(reports: DataFrame, report_type: str, schema, out: str) -> None:
    """Newest header payload per tenant, parsed, as JSON lines per tenant folder
    (detail tables are exported next to it with their own writers)."""
    r = latest_report(reports, report_type)
    (r.select("tenant_id", F.from_json("payload", schema).alias("p")).select("tenant_id", "p.*")
      .hint("rebalance", "tenant_id").write.mode("overwrite").partitionBy("tenant_id").json(out))


def rules_csv_rows(rules: DataFrame) -> DataFrame:
    """A12 rows: items joined by ', ', numbers with 4 decimals."""
    return rules.select(
        "tenant_id",
        F.array_join("antecedent", ITEM_SEP).alias("Antecedent"),
        F.array_join("consequent", ITEM_SEP).alias("Consequent"),
        fixed("support", 4).alias("Support"), fixed("confidence", 4).alias("Confidence"),
        fixed("lift", 4).alias("Lift"))


RULES_HEADER = "\ufeffAntecedent,Consequent,Support,Confidence,Lift"      # with a byte order mark


def export_rules_csv(rules: DataFrame, out: str) -> None:
    """Rule CSV per tenant.  Every file starts with a byte order mark and the header; item lists
    are always quoted (quotes in them doubled, line ends a blank), numbers and header never.

    The writer quotes all fields or those that need it, so lines are put together here and written
    as one field, with a separator and a quote that no line has."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, '"', '""'), "[\\r\\n\\x01\\x02]+", " "), F.lit('"'))
    rows = rules_csv_rows(rules)
    line = F.concat_ws(",", quoted("Antecedent"), quoted("Consequent"), "Support", "Confidence", "Lift")
    (rows.select("tenant_id", line.alias(RULES_HEADER)).hint("rebalance", "tenant_id").write.mode("overwrite")
     .partitionBy("tenant_id").option("header", True).option("sep", "\x01").option("quote", "\x02")
     .option("escape", "\x02").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
