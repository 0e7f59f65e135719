"""The nightly job runs over every row of the feed."""

from pyspark.sql import functions as F

from shopsight.operators import star as st
from shopsight.plans import jobs, q_jobs
from shopsight.sources.store import ReportStore
from shopsight.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_whole_night_keeps_every_row(spark):
    feed, tenants = q_jobs.whole_night(spark, SF)
    assert feed.filter(f"tenant_id < {q_jobs.SMALL}").count() == td.feed(spark, SF).count()
    small = {r.tenant_id for r in feed.filter(f"tenant_id >= {q_jobs.SMALL}").select("tenant_id").distinct().collect()}
    known = {r.tenant_id for r in tenants.collect()}
    assert small and small <= known and {n + q_jobs.EMPTY for n in range(25)} <= known - small
    assert tenants.count() == len(known) == 75


def test_whole_night_covers_all_tenants(spark):
    feed, _ = q_jobs.whole_night(spark, SF)
    clients = {r.tenant_id: r.n for r in feed.groupBy("tenant_id").agg({"client": "count"}).withColumnRenamed(
        "count(client)", "n").collect()}
    rows = q_jobs.run_all_tenants_whole(spark, SF).collect()
    assert len(rows) == 150 and {r.status for r in rows} == {"done", "skipped"}
    assert all((r.n > 0) == (r.tenant_id in clients) for r in rows)


def _star(spark, bad, n_tenants=16, clients=12):
    """A star whose dates of the tenants in ``bad`` cannot be read."""
    rows = [(t, f"c{c}", f"o{t}-{c}-{k}", f"2024-01-{1 + (c + k) % 28:02d}" if t not in bad else "no date", i)
            for t in range(n_tenants) for c in range(clients) for k in range(1 + c % 3) for i in "ab"]
    raw = spark.createDataFrame(rows, "tenant_id int, customer_hash string, order_id string, day string, product_code string")
    dated = raw.withColumn("transaction_date", F.col("day").cast("date").cast("timestamp_ntz"))
    items = dated.select("order_id", "tenant_id", "product_code", F.lit(1).alias("quantity"),
                         F.lit(2).cast("decimal(18,4)").alias("price"), "customer_hash", "transaction_date",
                         F.lit(0).cast("long").alias("batch_id"))
    orders = dated.filter("product_code = 'a'").select("order_id", "tenant_id", "customer_hash", "transaction_date",
                                                       F.lit("n").alias("order_number"))
    register = spark.createDataFrame([(t, "n", f"key_{t}", None) for t in range(n_tenants)], st.TENANTS)
    return st.Star(register, raw.select("tenant_id", "customer_hash").distinct(),
                   raw.select("tenant_id", "product_code", F.lit(2).cast("decimal(18,4)").alias("price")).distinct(),
                   orders, items)


def test_tenants_whose_data_raise_are_alone(spark, tmp_dir, monkeypatch):
    runs = []
    real = jobs.run_rfm
    monkeypatch.setattr(jobs, "run_rfm", lambda *a, **k: runs.append(1) or real(*a, ks=(2,), **k))
    reports = ReportStore(tmp_dir)
    rows = jobs.run_all_tenants(_star(spark, (3, 6), n_tenants=8), reports, created_at="2024-06-01 00:00:00", max_iter=5).collect()
    rfm = {r.tenant_id: (r.status, r.reason) for r in rows if r.report_type == "rfm_analysis"}
    assert {t for t, (s, _) in rfm.items() if s == "failed"} == {3, 6} and len(rfm) == 8
    assert all(s == "done" for t, (s, _) in rfm.items() if t not in (3, 6))
    assert "no date" in rfm[3][1]
    assert len(runs) <= 1 + 2 * 2 * 6                 # failing tenants x two halves x a few more than log2(8)
    assert sum(r.report_type == "fp_growth_rules" and r.status == "done" for r in rows) >= 6
    heads = reports.headers(spark).filter("report_type = 'rfm_analysis'").collect()
    assert sorted(r.tenant_id for r in heads) == [t for t in range(8) if t not in (3, 6)]    # each once


def test_a_fault_of_all_tenants_is_not_bisected_for_ever(spark):
    runs = []

    def job(star):
        runs.append(1)
        raise RuntimeError("no room")

    star = _star(spark, (), n_tenants=40, clients=1)
    rows = [r for s in jobs.isolated(star, "x", job, max_failed=3) for r in s.collect()]
    assert sorted(r.tenant_id for r in rows) == list(range(40)) and {r.status for r in rows} == {"failed"}
    assert len(runs) < 40


def test_failing_retention_is_a_row(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ReportStore, "retain", lambda *a: 1 / 0)
    monkeypatch.setattr(jobs, "isolated", lambda *a: [])
    rows = jobs.run_all_tenants(_star(spark, (), 1, 1), ReportStore(tmp_dir)).collect()
    assert [(r.tenant_id, r.report_type, r.status) for r in rows] == [(None, "retention", "failed")]
