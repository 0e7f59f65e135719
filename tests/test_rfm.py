"""Segmentation maths against numpy brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsight.operators import rfm

COLS = ("x", "y")


def _points(spark):
    rng = np.random.default_rng(7)
    rows = []
    for t in (1, 2):
        for c, (cx, cy) in enumerate([(0, 0), (5, 5), (0, 6)]):
            for i in range(12):
                rows.append((t, f"p{t}_{c}_{i}", float(cx + rng.normal()), float(cy + rng.normal()), c))
    rows.append((2, "single", 20.0, 20.0, 3))        # a cluster with one member
    return spark.createDataFrame(rows, "tenant_id int, buyer_id string, x double, y double, cluster_id int")


def _np(df, t):
    p = [r for r in df.collect() if r.tenant_id == t]
    return np.array([[r.x, r.y] for r in p]), np.array([r.cluster_id for r in p])


def _silhouette_sq(X, lab):
    s = []
    for i in range(len(X)):
        d = ((X - X[i]) ** 2).sum(1)
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def _db(X, lab):
    cs = sorted(set(lab))
    cent = np.array([X[lab == c].mean(0) for c in cs])
    sc = np.array([np.sqrt(((X[lab == c] - cent[i]) ** 2).sum(1)).mean() for i, c in enumerate(cs)])
    r = []
    for i in range(len(cs)):
        r.append(max((sc[i] + sc[j]) / np.sqrt(((cent[i] - cent[j]) ** 2).sum()) for j in range(len(cs)) if j != i))
    return float(np.mean(r))


def test_silhouette_and_davies_bouldin(spark):
    df = _points(spark)
    sil = {r.tenant_id: r.silhouette for r in rfm.silhouette(df, COLS, digits=10).collect()}
    db = {r.tenant_id: r.davies_bouldin for r in rfm.davies_bouldin(df, COLS, digits=10).collect()}
    for t in (1, 2):
        X, lab = _np(df, t)
        assert sil[t] == pytest.approx(_silhouette_sq(X, lab), abs=1e-9)
        assert db[t] == pytest.approx(_db(X, lab), abs=1e-9)


def test_standardize_and_correlation_constant_column(spark):
    df = spark.createDataFrame([(1, float(i), 3.0, float(i * 2)) for i in range(5)],
                               "tenant_id int, a double, b double, c double")
    z = rfm.standardize(df, ("a", "b"))
    assert [r.b for r in z.collect()] == [0.0] * 5
    a = np.arange(5.0)
    assert [r.a for r in z.orderBy("a").collect()] == pytest.approx(list((a - a.mean()) / a.std()))
    corr = {(r.feature_a, r.feature_b): r.r for r in rfm.correlation_matrix(df, ("a", "b", "c")).collect()}
    assert corr[("a", "c")] == 1.0 and corr[("a", "b")] == 0.0 and corr[("b", "b")] == 0.0


def test_recency_whole_days(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, "u", dt.datetime(2020, 1, 1, 12)), (1, "v", dt.datetime(2020, 1, 10, 6))],
                               "tenant_id int, buyer_id string, last_order_date timestamp_ntz")
    got = {r.buyer_id: r.recency for r in rfm.with_recency(df).collect()}
    assert got == {"u": 9, "v": 1}


def test_kmeans_recovers_blobs(spark):
    df = _points(spark).filter(F.col("cluster_id") < 3)
    cents = rfm.kmeans_fit(df, COLS, k=3, seed=1, n_init=3, order_by="x").collect()
    for t in (1, 2):
        X, lab = _np(df, t)
        exp = sorted((X[lab == c].mean(0)[0], X[lab == c].mean(0)[1]) for c in range(3))
        got = sorted((r.x, r.y) for r in cents if r.tenant_id == t)
        assert np.allclose(got, exp, atol=1e-9)             # converged to the blob means
        assert sum(r.size for r in cents if r.tenant_id == t) == 36


def test_pca_variance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(50, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]])
    df = spark.createDataFrame([(1, *map(float, r)) for r in X], "tenant_id int, a double, b double, c double")
    got = [r.explained_variance_pct for r in rfm.pca_variance(df, ("a", "b", "c"), digits=8).orderBy("component").collect()]
    ev = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    assert got == pytest.approx(list(ev / ev.sum() * 100), abs=1e-6)


def test_jacobi_eigenvalues_need_no_python_worker(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        ms = [rng.normal(size=(n, n)) * 10.0 ** e for e in (-6, 0, 6)] + [np.zeros((n, n)), np.ones((n, n))]
        ms = [m + m.T for m in ms] + [np.diag(np.arange(n, dtype=float))]
        df = spark.createDataFrame([(i, [float(x) for x in m.ravel()]) for i, m in enumerate(ms)], "i int, m array<double>")
        for r in df.select("i", rfm.eigenvalues(F.col("m"), n).alias("v")).collect():
            want = np.linalg.eigvalsh(ms[r.i])[::-1]
            assert r.v == pytest.approx(list(want), rel=1e-9, abs=1e-12 * (1 + abs(want).max()))
    flat = spark.createDataFrame([(1, 2.0, 3.0)] * 4, "tenant_id int, a double, b double")
    out = rfm.pca_variance(flat, ("a", "b"))
    assert all(math.isnan(r.explained_variance_pct) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_exact_mean_rounding_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.175), (1, 0, 0.195), (1, 0, 2.0)], "tenant_id int, cluster_id int, m double")
    r = rfm.cluster_summary(df, cols=("m",)).first()
    assert r.m == 0.79                     # (0.175 + 0.195 + 2.0) / 3 = 0.79
    df2 = spark.createDataFrame([(1, 0, 0.37), (1, 0, 0.0)], "tenant_id int, cluster_id int, m double")
    assert rfm.cluster_summary(df2, cols=("m",)).first().m == 0.19     # 0.185 rounds half up


def test_salted_join_spreads_a_hot_tenant(spark):
    from pyspark.sql import functions as F
    from shopsight.operators import rfm
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 300).cast("int").alias("tenant_id"),
                                    F.col("id").alias("buyer_id"), (F.col("id") % 97).cast("double").alias("recency"),
                                    (F.col("id") % 13).cast("double").alias("frequency"), (F.col("id") % 31).cast("double").alias("monetary"))
    z = rfm.standardize(rows)
    assert z.count() == 9000
    got = z.groupBy("tenant_id").agg(F.avg("recency").alias("m"), F.stddev_pop("recency").alias("s")).filter("abs(m) > 1e-9 or abs(s - 1) > 1e-9 and s <> 0")
    assert got.count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rfm.standardize(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(tenant_id" in plan and "__salt" in plan


def test_kmeans_reports_convergence(spark):
    from shopsight.operators import rfm
    rows = [(1, i, float(i % 2) * 10 + i * 0.001, 0.0, float(i % 2) * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "tenant_id int, buyer_id long, recency double, frequency double, monetary double")
    done = rfm.kmeans_fit(df, k=2).collect()
    assert all(r.converged and 1 <= r.iterations < 300 for r in done) and sorted(r.size for r in done) == [30, 30]
    cut = rfm.kmeans_fit(df, k=[2, 5], max_iter=1).collect()
    assert {r.iterations for r in cut} == {1} and len(cut) == 7


def test_kpis_of_tenants_without_items(spark):
    from shopsight.operators import kpi
    items = spark.createDataFrame([(1, "a", 2, 3.0)], "tenant_id int, customer_hash string, quantity int, price double")
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    got = {r.tenant_id: (r.total_revenue, r.total_customers, r.avg_revenue_per_customer)
           for r in kpi.kpis(items, tenants=tenants).collect()}
    assert got == {1: (6.0, 1, 6.0), 2: (0.0, 0, 0.0)}


# --- k-means|| and the sweep against plain forms ---------------------------------------

def _blobs(spark, tenants, sizes, seed=7):
    import numpy as np
    rng = np.random.default_rng(seed)
    rows, best = [], {}
    for t in range(tenants):
        centres = rng.permutation(len(sizes) * 4)[:len(sizes)][:, None] * np.array([[40.0, 25.0, 60.0]])
        parts = [c + rng.normal(size=(n, 3)) for c, n in zip(centres, sizes)]
        best[t] = sum(((p - p.mean(0)) ** 2).sum() for p in parts)
        rows += [(t, f"c{i}", *map(float, x)) for i, x in enumerate(np.concatenate(parts))]
    return spark.createDataFrame(rows, "tenant_id int, buyer_id string, recency double, frequency double, monetary double"), best


def test_seeding_finds_small_blobs(spark):
    """Two large blobs and six small ones: random rows nearly all fall into the large ones."""
    df, best = _blobs(spark, 3, [400, 400, 6, 6, 6, 6, 6, 6])
    models = rfm.kmeans_fit(df, k=8, n_init=1).groupBy("tenant_id").agg({"inertia": "max", "size": "min"}).collect()
    for r in models:
        assert abs(r["max(inertia)"] / best[r.tenant_id] - 1) < 1e-6 and r["min(size)"] == 6


def test_seeds_of_few_and_equal_rows(spark):
    rows = [(1, f"c{i}", 1.0, 2.0, 3.0) for i in range(5)] + [(2, "a", 0.0, 0.0, 0.0), (2, "b", 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "tenant_id int, buyer_id string, recency double, frequency double, monetary double")
    got = rfm.kmeans_fit(df, k=[3], n_init=2).collect()
    assert sorted((r.tenant_id, r.size) for r in got) == [(1, 0), (1, 0), (1, 5), (2, 1), (2, 1)]
    assert {r.inertia for r in got} == {0.0}
    assert rfm.kmeans_fit(df.limit(0), k=3).count() == 0


def test_sweep_scores_equal_plain_scores(spark):
    import numpy as np
    df, _ = _blobs(spark, 2, [30, 20, 25, 8])
    models = rfm.kmeans_fit(df, k=[2, 3, 4, 5], n_init=1).checkpoint()
    got = {(r.tenant_id, r.k): (r.silhouette, r.db_index) for r in rfm.kmeans_sweep(df, ks=[2, 3, 4, 5], centroids=models).collect()}
    points, cents = df.toPandas(), models.toPandas()
    assert len(got) == 8
    for (t, k), (sil, db) in got.items():
        x = points[points.tenant_id == t][list(rfm.FEATURES)].to_numpy()
        c = cents[(cents.tenant_id == t) & (cents.k == k)].sort_values("cluster_id")[list(rfm.FEATURES)].to_numpy()
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        scores = []
        for i, a in enumerate(label):
            own = label == a
            if own.sum() == 1:
                scores.append(0.0)
                continue
            inner = d[i][own].sum() / (own.sum() - 1)
            outer = min(d[i][label == b].mean() for b in set(label.tolist()) - {a})
            scores.append((outer - inner) / max(inner, outer))
        assert abs(sil - np.mean(scores)) < 1e-4
        used = sorted(set(label.tolist()))
        mean = {b: x[label == b].mean(0) for b in used}
        s = {b: np.sqrt(((x[label == b] - mean[b]) ** 2).sum(1)).mean() for b in used}
        plain = np.mean([max((s[a] + s[b]) / np.linalg.norm(mean[a] - mean[b]) for b in used if b != a) for a in used])
        assert abs(db - plain) < 1e-4
