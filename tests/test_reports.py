import datetime as dt

from pyspark.sql import functions as F

from shopsight.operators import advice as ad
from shopsight.operators import reports as rp


def _reports(spark):
    rows = [(f"r{i}", 1, "rfm_analysis", '{"x": %d}' % i, dt.datetime(2024, 1, i + 1)) for i in range(4)]
    rows.append(("q0", 2, "rfm_analysis", "{}", dt.datetime(2024, 1, 1)))
    return spark.createDataFrame(rows, "report_id string, tenant_id int, report_type string, payload string, "
                                       "created_at timestamp_ntz")


def test_retention_keeps_three_newest(spark):
    kept = rp.retain_latest(_reports(spark), 3).collect()
    assert sorted(r.report_id for r in kept) == ["q0", "r1", "r2", "r3"]
    latest = {r.tenant_id: r.report_id for r in rp.latest_report(_reports(spark), "rfm_analysis").collect()}
    assert latest == {1: "r3", 2: "q0"}
    assert rp.latest_report(_reports(spark), "fp_growth_rules").count() == 0   # "not found"


def test_segments_round_trip_and_bubbles(spark):
    summary = spark.createDataFrame([(1, 0, 10.0, 2.0, 100.0, 5), (1, 1, 40.0, 1.0, 0.0, 3)],
                                    "tenant_id int, cluster_id int, recency double, frequency double, "
                                    "monetary double, customer_count long")
    perf = spark.createDataFrame([(1, 0.5, 0.7)], "tenant_id int, silhouette double, davies_bouldin double")
    corr = spark.createDataFrame([(1, "a", "a", 1.0)], "tenant_id int, feature_a string, feature_b string, r double")
    payload = rp.rfm_payload(summary, perf, None, corr, {"recency": 1.0}, 2)
    headers = rp.report_rows(payload, rp.RFM_TYPE, F.lit("2024-01-01 00:00:00"))
    seg = rp.segments_table(headers).orderBy("cluster").collect()
    assert [(s.buyer_id, s.monetary, s.customer_count) for s in seg] == [("Cluster 0", 100.0, 5), ("Cluster 1", 0.0, 3)]
    b = rp.segment_bubbles(rp.segments_table(headers)).orderBy("cluster").collect()
    assert b[0].sizeref == 2.0 * 100.0 / 6400 and b[0].name == "Сегмент 0 (5 чол)"


def test_rules_are_detail_rows(spark):
    rules = spark.createDataFrame([(1, ["a"], ["b"], 0.1, 0.5, 2.0)],
                                  "tenant_id int, antecedent array<string>, consequent array<string>, "
                                  "support double, confidence double, lift double")
    summ = spark.createDataFrame([(1, 10, 1)], "tenant_id int, total_orders long, rules_found long")
    headers = rp.report_rows(rp.basket_payload(summ, 0.01, 0.5), rp.BASKET_TYPE, F.lit("2024-01-01 00:00:00"))
    t = rp.rules_table(headers, rp.rule_rows(rules, headers)).first()
    assert (t.if_bought, t.then_buy, t.min_support) == (["a"], ["b"], 0.01)


def test_segment_advice_rules(spark):
    df = spark.createDataFrame([(1, "Кластер 13"), (1, "Risk group"), (1, "Cluster 0"), (1, "Кластер 13")],
                               "tenant_id int, cluster_name string")
    got = {r.cluster_name: r.advice for r in ad.segment_advice(df).collect()}
    assert len(got) == 3 and got["Кластер 13"] == ad.ADVICE_TOP
    assert got["Risk group"] == ad.ADVICE_RISK and got["Cluster 0"] == ad.ADVICE_DEFAULT


def test_prompt_numbers_like_python(spark):
    df = spark.createDataFrame([(1, "C", 12.0, 2.5, 49804976.19)],
                               "tenant_id int, cluster_name string, recency double, frequency double, monetary double")
    p = ad.segment_prompt(df, "shop").first().prompt
    assert "Давність покупки: 12.0 днів" in p and "Частота замовлень: 2.5" in p
    assert "Середній чек: 49804976.19 грн." in p


def _store(spark, tmp_dir):
    import os
    from shopsight.sources.store import ReportStore
    store = ReportStore(os.path.join(tmp_dir, "r"))
    heads = _reports(spark)
    rules = spark.createDataFrame([(r.report_id, r.tenant_id, ["a"], ["b"], 0.1, 0.2, 0.3) for r in heads.collect()],
                                  ReportStore.DETAILS["rules"])
    store.append(heads, {"rules": rules})
    return store, heads


def _files(base):
    import glob
    import os
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{base}/**/*.parquet", recursive=True)}


def test_report_store_retention(spark, tmp_dir):
    store, _ = _store(spark, tmp_dir)
    other = spark.createDataFrame([("z1", 9, "t", "{}", None)], store.headers(spark).schema)
    store.append(other, {"rules": spark.createDataFrame([("z1", 9, ["a"], ["b"], 0.1, 0.2, 0.3)], store.DETAILS["rules"])})
    before = _files(store.base)
    store.retain(spark, keep=3)
    assert sorted(r.report_id for r in store.headers(spark).collect()) == ["q0", "r1", "r2", "r3", "z1"]
    assert sorted(r.report_id for r in store.details(spark, "rules").collect()) == ["q0", "r1", "r2", "r3", "z1"]
    after = _files(store.base)
    quiet = [f for f in before if "tenant_id=9" in f]
    assert len(quiet) == 2 and all(after.get(f) == before[f] for f in quiet)
    store.retain(spark, keep=3)                                   # nothing expired: nothing written
    assert _files(store.base) == after


def test_retention_drops_a_partition_that_gets_no_row(spark, tmp_dir):
    """The kept reports of a tenant have no rule, the expired one had."""
    import datetime as dt
    from shopsight.sources.store import ReportStore
    store = ReportStore(tmp_dir)
    heads = spark.createDataFrame([(f"r{i}", 1, "t", "{}", dt.datetime(2024, 1, 1 + i)) for i in range(4)],
                                  store.headers(spark).schema)
    store.append(heads, {"rules": spark.createDataFrame([("r0", 1, ["a"], ["b"], 0.1, 0.2, 0.3)], store.DETAILS["rules"])})
    store.retain(spark, keep=3)
    assert store.details(spark, "rules").count() == 0 and store.headers(spark).count() == 3


def test_empty_report_tables(spark, tmp_dir):
    """No headers, no rules, no tenants: everything can be read back and retained."""
    from shopsight.plans import jobs
    from shopsight.sources.store import ReportStore
    store = ReportStore(tmp_dir)
    store.retain(spark)
    assert store.headers(spark).count() == 0 and store.details(spark, "rules").count() == 0
    tx = spark.createDataFrame([(1, f"o{i}", f"p{i}") for i in range(20)],
                               "tenant_id int, order_id string, product_code string")
    for frame in (tx, tx.limit(0)):
        headers, rules = jobs.run_basket(frame, store, 0.9, 0.9)
        assert headers.count() == rules.count() == 0
    store.retain(spark)
    assert store.headers(spark).count() == store.details(spark, "rules").count() == 0
    assert store.details(spark, "assignments").columns == ["report_id", "tenant_id", "id", "cid"]
