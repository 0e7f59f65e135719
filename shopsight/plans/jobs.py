"""Whole jobs (J1-J4): load a feed into the star, RFM segmentation, market
basket mining, and the nightly run over every tenant.

Every job handles all tenants in one set of Spark jobs (``tenant_id`` is a
grouping key everywhere); a tenant filter only narrows the input.  Guards that
skip a tenant (too few customers or orders, nothing frequent) are semi joins,
so one small tenant never stops the others; the nightly run isolates tenants whose
data make a job fail.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from typing import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.operators import basket as bk
from shopsight.operators import cleaning, kpi, reports as rp, rfm, star as st
from shopsight.session import checkpoint_dir, staged
from shopsight.sources.store import ReportStore, StarStore

MIN_CUSTOMERS = 10
MIN_ORDERS = 10
DEFAULT_WEIGHTS = {"recency": 1.0, "frequency": 1.0, "monetary": 1.0}


# --- J4: load ------------------------------------------------------------------

def load(feed: DataFrame, store: StarStore, batch_id: int, seq_cols: Sequence[str],
         mode: str = "full", marker: str | None = None, tenants: DataFrame | None = None,
         keep: Sequence[str] = (), overlap: str | None = None) -> DataFrame:
    """Full or delta load of a feed batch into the store; returns per-tenant counters.

    A feed with ``tenant_key`` is resolved against ``tenants`` first (unknown keys are
    rejected); delta mode keeps rows strictly after the normalised marker.  A row that arrives
    late, with the marker's own time or an older one, is lost that way; ``overlap`` reads that much
    time before the marker again and stores what is not there yet.  The source is read once:
    rows and counters come from the same pass.
    """
    if mode == "delta":
        feed = cleaning.delta(feed, marker, overlap=overlap)
    return store.write_feed(feed, batch_id, seq_cols, keep=keep, tenants=tenants,
                            new_since=cleaning.since(marker, overlap) if mode == "delta" and overlap else None)


# --- J1: RFM segmentation ---------------------------------------------------------

def run_rfm(star: st.Star, reports: ReportStore | None = None, k: int = 3,
            weights: dict | None = None, ks: Iterable[int] = range(2, 10), tenant_id: int | None = None,
            created_at: str | None = None, seed: int = 42, max_iter: int = 300) -> tuple[DataFrame, DataFrame]:
    """RFM report per tenant: (headers, assignment rows); appended to ``reports`` if given.

    Tenants with fewer than 10 customers get none (``rfm_status`` says so).  The document
    compares the weighted model with the unweighted baseline (G7)."""
    weights = weights or DEFAULT_WEIGHTS
    checkpoint_dir(star.orders.sparkSession)
    metrics = kpi.rfm_metrics(cleaning.for_tenant(star.orders, tenant_id),
                              cleaning.for_tenant(star.order_items, tenant_id))
    metrics = cleaning.tenants_with_min(staged(metrics, "rfm-metrics"), ["tenant_id"], MIN_CUSTOMERS)
    feats = staged(rfm.with_recency(metrics), "rfm-features")          # reused by every fit below
    scaled = rfm.standardize(feats, keep_raw=True)
    weighted = rfm.weight(scaled, weights)
    ks = sorted(set(ks))
    models = rfm.kmeans_fit(weighted, k=sorted(set(ks) | {k}), seed=seed, max_iter=max_iter).checkpoint()  # every k once
    sweep = rfm.kmeans_sweep(weighted, ks=ks, centroids=models)
    cents = models.filter(F.col("k") == k).drop("k")
    assigned = staged(rfm.assign_clusters(weighted, cents), "rfm-labels")
    perf = rfm.silhouette(assigned).join(rfm.davies_bouldin(assigned), "tenant_id")
    raw = assigned.select("tenant_id", "buyer_id", "cluster_id",
                          *[F.col(f"raw_{c}").alias(c) for c in rfm.FEATURES])
    summary = rfm.cluster_summary(raw)
    corr = rfm.correlation_matrix(feats)
    if any(w != 1.0 for w in weights.values()):
        base = rfm.assign_clusters(scaled, rfm.kmeans_fit(scaled, k=k, seed=seed, max_iter=max_iter).drop("k"))
        base = rfm.silhouette(base).join(rfm.davies_bouldin(base), "tenant_id")
    else:
        base = perf                                  # all weights 1: the baseline is the model itself
    payload = rp.rfm_payload(summary, perf, sweep, corr, weights, k, rfm.compare_models(base, perf))
    ts = F.lit(created_at) if created_at else None
    headers = rp.report_rows(payload, rp.RFM_TYPE, ts).checkpoint()
    rows = rp.assignment_rows(assigned, headers)
    if reports is not None:
        reports.append(headers, {"assignments": rows})
    return headers, rows


# --- J2: market basket ----------------------------------------------------------------

def run_basket(tx: DataFrame, reports: ReportStore | None = None, min_support: float = 0.01,
               min_confidence: float = 0.5, top_n: int | None = None, created_at: str | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """Basket report per tenant: (headers, rule rows); tenants with fewer than 10
    orders, no frequent itemset or no rule get no report (``basket_status`` says why)."""
    checkpoint_dir(tx.sparkSession)
    b = bk.baskets(bk.keep_top_items(tx, top_n))
    b = cleaning.tenants_with_min(b, ["tenant_id"], MIN_ORDERS).checkpoint()
    sets = bk.frequent_itemsets(b, min_support)
    rules = bk.rounded_rules(bk.association_rules(sets, min_confidence)).checkpoint()
    summary = bk.basket_summary(b, rules).filter(F.col("rules_found") > 0)
    payload = rp.basket_payload(summary, min_support, min_confidence)
    ts = F.lit(created_at) if created_at else None
    headers = rp.report_rows(payload, rp.BASKET_TYPE, ts).checkpoint()
    rows = rp.rule_rows(rules, headers)
    if reports is not None:
        reports.append(headers, {"rules": rows})
    return headers, rows


# --- B16: what became of every tenant ------------------------------------------------------

def job_status(counts: DataFrame, headers: DataFrame, report_type: str, minimum: int, unit: str,
               no_result: str) -> DataFrame:
    """(tenant_id, report_type, status, reason, n): done, or skipped and why, for every tenant
    of ``counts`` (tenant_id, n)."""
    done = headers.select("tenant_id", F.lit(True).alias("__done"))
    reason = (F.when(F.col("__done"), F.lit(None).cast("string"))
              .when(F.col("n") < minimum, F.lit(f"fewer than {minimum} {unit}")).otherwise(F.lit(no_result)))
    return (counts.join(done, "tenant_id", "left")
            .select("tenant_id", F.lit(report_type).alias("report_type"),
                    F.when(F.col("__done"), "done").otherwise("skipped").alias("status"), reason.alias("reason"), "n"))


def rfm_status(star: st.Star, headers: DataFrame) -> DataFrame:
    """Status of every tenant of the register after ``run_rfm``."""
    n = kpi.rfm_metrics(star.orders, star.order_items).groupBy("tenant_id").agg(F.count("*").alias("n"))
    counts = star.tenants.select("tenant_id").join(n, "tenant_id", "left").select(
        "tenant_id", F.coalesce("n", F.lit(0)).alias("n"))
    return job_status(counts, headers, rp.RFM_TYPE, MIN_CUSTOMERS, "customers", "no model")


def basket_status(tx: DataFrame, headers: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Status of every tenant (of the register, if given) after ``run_basket``."""
    n = bk.order_counts(bk.baskets(tx)).withColumnRenamed("n_orders", "n")
    if tenants is not None:
        n = tenants.select("tenant_id").join(n, "tenant_id", "left").select(
            "tenant_id", F.coalesce("n", F.lit(0)).alias("n"))
    return job_status(n, headers, rp.BASKET_TYPE, MIN_ORDERS, "orders", "no frequent itemset or no rule")


# --- J3: nightly run -------------------------------------------------------------------

@dataclass(frozen=True)
class Part:
    """A share of the tenants: those whose hashed id ends with ``bits`` given bits."""
    bits: int = 0
    value: int = 0

    def has(self):
        return F.pmod(F.xxhash64("tenant_id"), F.lit(1 << self.bits)) == self.value

    def halves(self) -> list["Part"]:
        return [Part(self.bits + 1, self.value + (b << self.bits)) for b in (0, 1)]


def of_part(star: st.Star, part: Part) -> st.Star:
    """The star of a share of the tenants."""
    return star if not part.bits else st.Star(*[getattr(star, f.name).filter(part.has()) for f in fields(star)])


def isolated(star: st.Star, kind: str, job: Callable[[st.Star], DataFrame], max_failed: int = 32) -> list[DataFrame]:
    """Statuses of a job over all tenants.  Where it fails it is run again over halves of its
    tenants until those that make it fail are alone; the others finish.

    A failing tenant costs about two runs for every halving, log2 of the number of tenants.
    With more than ``max_failed`` of them the fault is not the tenants': what has not finished
    is reported as failed without more runs."""
    todo, statuses, failed = [Part()], [], 0
    while todo:
        part = todo.pop()
        mine = of_part(star, part)
        if part.bits and mine.tenants.isEmpty():
            continue
        try:
            statuses.append(job(mine))
        except Exception as e:                       # other tenants are not stopped; the failure is a result
            few = mine.tenants.select("tenant_id").distinct().limit(2).count()
            if few > 1 and failed < max_failed and part.bits < 62:
                todo += part.halves()
                continue
            failed += 1
            if few:
                statuses.append(mine.tenants.select(
                    "tenant_id", F.lit(kind).alias("report_type"), F.lit("failed").alias("status"),
                    F.lit(f"{type(e).__name__}: {e}"[:500]).alias("reason"), F.lit(None).cast("long").alias("n")))
    return statuses


def run_all_tenants(star: st.Star, reports: ReportStore, keep: int = 3, min_support: float = 0.01,
                    min_confidence: float = 0.5, created_at: str | None = None, max_iter: int = 300) -> DataFrame:
    """Both jobs for every tenant, then retention; returns the status of every (tenant, report
    type) and, should retention fail, a row without tenant that says so.

    Results are computed before the first of them is appended, so a run that fails leaves
    nothing of its own behind, and the status of a job never stops the other."""
    spark = star.orders.sparkSession

    def rfm_job(s: st.Star) -> DataFrame:
        headers, rows = run_rfm(s, created_at=created_at, max_iter=max_iter)
        status = rfm_status(s, headers).checkpoint()
        reports.append(headers, {"assignments": rows.checkpoint()})
        return status

    def basket_job(s: st.Star) -> DataFrame:
        tx = bk.transactions(s)
        headers, rows = run_basket(tx, None, min_support, min_confidence, created_at=created_at)
        status = basket_status(tx, headers, s.tenants).checkpoint()
        reports.append(headers, {"rules": rows.checkpoint()})
        return status

    statuses = isolated(star, rp.RFM_TYPE, rfm_job) + isolated(star, rp.BASKET_TYPE, basket_job)
    try:
        reports.retain(spark, keep)
    except Exception as e:
        statuses.append(spark.createDataFrame([(None, "retention", "failed", f"{type(e).__name__}: {e}"[:500], None)],
                                              "tenant_id int, report_type string, status string, reason string, n long"))
    return reduce(DataFrame.unionByName, statuses)
