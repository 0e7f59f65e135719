"""Steps that several branches of a plan read are computed once, and passes stay cheap."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shopsight.operators import cleaning, rfm
from shopsight.plans import common, q_basket, q_reports, q_star
from shopsight.sources import testdata as td
from shopsight.sources.store import StarStore


def _tables(tmp_dir: str) -> str:
    """A few customers, orders and lines in the layout of the driver's tables."""
    n = 12
    frames = {
        "nation": pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["A", "B"]}),
        "customer": pd.DataFrame({"c_custkey": range(n), "c_name": [f"Customer#{i:09d}" for i in range(n)],
                                  "c_nationkey": [i % 2 for i in range(n)]}),
        "part": pd.DataFrame({"p_partkey": range(5), "p_brand": [f"Brand#{i}" for i in range(5)]}),
        "orders": pd.DataFrame({"o_orderkey": range(4 * n), "o_custkey": [i % n for i in range(4 * n)],
                                "o_orderdate": [dt.datetime(1997, 6, 1) + dt.timedelta(days=11 * i) for i in range(4 * n)]}),
        "lineitem": pd.DataFrame({"l_orderkey": [i // 2 for i in range(8 * n)], "l_partkey": [i * 7 % 5 for i in range(8 * n)],
                                  "l_linenumber": [i % 2 + 1 for i in range(8 * n)], "l_quantity": [float(i % 9 + 1) for i in range(8 * n)],
                                  "l_extendedprice": [10.0 + i % 13 for i in range(8 * n)]}),
    }
    for name, f in frames.items():
        f.to_parquet(f"{tmp_dir}/{name}.parquet", coerce_timestamps="us")
    return tmp_dir


def _counted(monkeypatch, module, name: str) -> list:
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **kw: calls.append(1) or plain(*a, **kw))
    return calls


def _scans(df, table: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{table}#")


def test_reports_derive_the_features_once(spark, tmp_dir, monkeypatch):
    sf = _tables(tmp_dir)
    calls = _counted(monkeypatch, common, "rfm_metrics")
    assert q_reports.report_segments(spark, sf).groupBy().sum("customer_count").first()[0] == 12
    assert len(calls) == 1
    assert q_reports.report_bubbles(spark, sf).count() > 0 and len(calls) == 2
    assert q_reports.export_assignments(spark, sf).count() == 12 and len(calls) == 3


def test_plans_read_the_lines_once(spark, tmp_dir):
    sf = _tables(tmp_dir)
    for df in (q_star.orders_upsert(spark, sf), q_star.items_known_only(spark, sf), q_basket.transactions(spark, sf),
               common.rfm_features(spark, sf), cleaning.mark_cap(td.dirty_feed(spark, sf), 7, ["l_orderkey"])):
        assert _scans(df, "l_orderkey") == 0 or "lineitem" not in "".join(df.inputFiles())
        assert df.count() > 0


def test_headers_meet_their_clients_before_the_lines(spark, tmp_dir):
    """Lines are joined twice, not three times: with parts, and with headers that have their client."""
    sf = _tables(tmp_dir)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (td.feed(spark, sf), td.brand_transactions(spark, sf)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            customers = next(x for x in plan.splitlines() if "c_custkey" in x and "Join" in x)
            assert "o_custkey" in customers
            lines = [x for x in plan.splitlines() if "Join Inner" in x]
            assert len(lines) == 3 and lines.index(customers) == 2      # the deepest join on the headers' side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_unseen_counts_copies_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 1, "x"), (None, 2, "y"), ("b", None, "z"), ("c", 3, "w")],
                                 "k string, n int, rest string")
    stored = spark.createDataFrame([("a", 1), (None, 2), ("d", 4)], "k string, n int")
    got = cleaning.unseen(rows, stored, ["k", "n"])
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        ("a", 1, "x")] * 0 + [r for r in rows.filter("rest in ('z', 'w')").collect()] + rows.filter("rest = 'x'").limit(2).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_late_rows_older_equal_and_newer_than_the_store(spark, tmp_dir):
    def feed(*rows):
        return spark.createDataFrame([(1, "c", "s", q, 5.0, dt.datetime(2024, 1, d), i) for d, q, i in rows],
                                     "tenant_id int, client string, sku string, qty int, price double, "
                                     "transaction_date timestamp_ntz, line int")
    store = StarStore(f"{tmp_dir}/star")
    store.write_feed(feed((1, 1, 1), (5, 1, 2)), 0, ["line"])
    later = feed((1, 1, 1), (5, 1, 2), (5, 1, 2), (4, 1, 3), (9, 1, 4), (9, -1, 5))
    store.write_feed(later, 1, ["line"], new_since=F.lit("2023-12-01 00:00:00").cast("timestamp_ntz"))
    got = sorted((r.batch_id, r.seq.line, r.reject_reason) for r in store.lines(spark).collect())
    assert got == [(0, 1, None), (0, 2, None), (1, 2, None), (1, 3, None), (1, 4, None), (1, 5, "quantity_not_positive")]


def test_lines_are_placed_before_they_are_hashed(spark, tmp_dir, monkeypatch):
    """The write's shuffle moves raw lines: it is below the projection with the hashes."""
    store, seen = StarStore(f"{tmp_dir}/star"), []
    plain = StarStore._write
    monkeypatch.setattr(StarStore, "_write", lambda self, rows, *a: seen.append(rows) or plain(self, rows, *a))
    rows = [(t, "c", "s", 1, 5.0, dt.datetime(2024, 1, 1), 1) for t in range(40)]
    store.write_feed(spark.createDataFrame(rows, "tenant_id int, client string, sku string, qty int, price double, "
                                                 "transaction_date timestamp_ntz, line int"), 0, ["line"])
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {w: next(i for i, x in enumerate(plan) if w in x) for w in ("sha2", "RebalancePartitions")}
    assert at["sha2"] < at["RebalancePartitions"]
    assert store.lines(spark).select("tenant_bucket", "tenant_id").distinct().count() == 40


def test_a_pass_joins_chunks_not_customers(spark):
    """Two tenants and one without key: 5,000 rows are a few chunks, and all rows are in them."""
    df = spark.range(5000).select(
        F.when(F.col("id") < 4500, 1).when(F.col("id") < 4990, 2).cast("int").alias("tenant_id"), F.col("id").alias("buyer_id"),
        (F.col("id") % 7).cast("double").alias("x"))
    chunks = rfm.chunked(df, ("x",), ["tenant_id"], "buyer_id")
    got = {t: (n, rows) for t, n, rows in chunks.groupBy("tenant_id").agg(F.count("*"), F.sum(F.size("__rows"))).collect()}
    assert got == {1: (3, 4500), 2: (1, 490)}


def test_kmeans_equals_plain_lloyd_from_its_seeds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2)) + rng.integers(0, 4, size=(700, 1)) * 3
    df = spark.createDataFrame([(7, f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "tenant_id int, buyer_id string, a double, b double")
    monkeypatch.setattr(rfm, "CHUNK", 100)
    start = rfm.seeds(df, ("a", "b"), ["tenant_id"], "buyer_id", 4, n_init=1).orderBy("__rn").collect()
    points = {(r.a, r.b) for r in df.collect()}
    c = np.array([[r.a, r.b] for r in start])
    assert len(c) == 4 and all((r.a, r.b) in points for r in start)
    for n in range(1, 301):
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) for i in range(4)])
        done = ((new - c) ** 2).sum(1).max() <= 1e-4
        c = new
        if done:
            break
    for few in (1000, 0):                                # models broadcast, and joined by key and salt
        monkeypatch.setattr(rfm, "FEW_KEYS", few)
        got = rfm.kmeans_fit(df, ("a", "b"), k=4, n_init=1, order_by="a").orderBy("cluster_id").collect()
        assert np.allclose([[r.a, r.b] for r in got], c[np.argsort(-c[:, 0])], atol=1e-9)
        assert {r.iterations for r in got} == {n} and sum(r.size for r in got) == 700
        d = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        assert abs(got[0].inertia - d) < 1e-6
