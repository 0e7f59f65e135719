import datetime as dt
import random

from pyspark.sql import functions as F

from shopsight.operators import cleaning as C

TS = dt.datetime(2020, 1, 1, 10, 0, 0)


def _feed(spark, rows):
    return spark.createDataFrame(
        rows, "tenant_id int, client string, sku string, qty string, price double, transaction_date timestamp_ntz")


def test_reject_reasons(spark):
    rows = [
        (1, None, "A", "1", 1.0, TS),           # null client
        (1, "  ", "A", "1", 1.0, TS),           # blank client
        (1, "c", "\t ", "1", 1.0, TS),          # blank sku
        (1, "c", "A", "3.0", 1.0, TS),          # '3.0' is not an int literal
        (1, "c", "A", "x", 1.0, TS),            # junk quantity
        (1, "c", "A", "-2", 1.0, TS),           # not positive
        (1, "c", "A", "1", 0.0, TS),            # price 0
        (1, "c", "A", "1", -1.0, TS),           # price < 0
        (1, "c", "A", "1", float("nan"), TS),   # NaN price (the reference lets it pass)
        (1, "c", "A", "1", 1.0, None),          # no date
        (1, "\tc ", " A ", " 7 ", 2.5, TS),     # valid after stripping
    ]
    r = C.rejected_feed(_feed(spark, rows)).select("reject_reason").collect()
    assert [x[0] for x in r] == ["null_field", "empty_client", "empty_sku", "bad_quantity",
                                 "bad_quantity", "quantity_not_positive", "price_not_positive",
                                 "price_not_positive", "bad_price", "null_date"]
    c = C.clean_feed(_feed(spark, rows)).collect()
    assert len(c) == 1
    assert (c[0].product_code, c[0].quantity, float(c[0].price), c[0].order_date) == \
        ("A", 7, 2.5, "2020-01-01 10:00:00")


def test_numeric_quantity_truncates(spark):
    df = spark.createDataFrame([(1, "c", "A", 3.7, 1.0, TS)],
                               "tenant_id int, client string, sku string, qty double, price double, "
                               "transaction_date timestamp_ntz")
    assert C.clean_feed(df).first().quantity == 3


def test_stats_and_delta(spark):
    rows = [(1, "c", "A", "1", 1.0, TS), (1, "c", "A", "x", 1.0, TS),
            (2, "d", "B", "2", 3.0, dt.datetime(1997, 1, 1))]
    f = _feed(spark, rows)
    s = {r.tenant_id: (r.processed, r.sent, r.filtered) for r in C.ingest_stats(f).collect()}
    assert s == {1: (2, 1, 1), 2: (1, 1, 0)}
    assert C.delta(f, "1998-01-01T00:00:00.5+02:00").count() == 2
    assert C.delta(f, None).count() == 3


def test_capped_and_union(spark):
    f = spark.range(100).withColumn("v", F.col("id") % 7)
    assert [r.id for r in C.capped(f, 3, ["v", "id"]).collect()] == [0, 7, 14]
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    u = C.union_feeds([a, b]).orderBy("k").collect()
    assert [(r.k, r.a, r.b) for r in u] == [(1, "x", None), (2, None, "y")]


def test_workbook_coercion(spark):
    df = spark.createDataFrame(
        [(12345.0, 85123, "2.55", "6"), (None, 1, "1", "1"), (7.0, 2, "n/a", "x"), (8.0, 3, "1.5", "2.9")],
        "`Customer ID` double, StockCode long, Price string, Quantity string")
    r = C.coerce_workbook(df).orderBy("StockCode").collect()
    assert [(x["Customer ID"], x.StockCode, x.Price, x.Quantity) for x in r] == [
        ("7", "2", 0.0, 0), ("8", "3", 1.5, 2), ("12345", "85123", 2.55, 6)]


def test_min_group_guard(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 1)], "tenant_id int, x int")
    assert {r.tenant_id for r in C.tenants_with_min(df, ["tenant_id"], 10).collect()} == {1}


def test_tenant_scope(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "tenant_id int, x string")
    assert sorted(r.x for r in C.for_tenant(df, 1).collect()) == ["a", "c"]
    assert C.for_tenant(df, None).count() == 3


def test_cut_key_by_selection(spark):
    """The n-th key whatever the ties and nulls; a key that a third of the rows share; few rows."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 3, rng.randrange(50)]), rng.choice([None, "a", "b"]), rng.random() if i % 3 else 0.5)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(6).persist()
    key = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    want = sorted(rows, key=key)
    for n in (1, 2, 700, 1500, 2999, 3000, 9999):
        for few in (1, 40, 5000):
            got = df.select(C.nth_key(df, n, ["a", "b", "c"], pivots=5, few=few).alias("k")).first()["k"]
            assert tuple(got) == want[min(n, 3000) - 1]
    same = spark.createDataFrame([(7,)] * 500, "a int")
    assert same.select(C.nth_key(same, 90, ["a"], few=10).alias("k")).first()["k"] == (7,)
    assert C.nth_key(df.limit(0), 5, ["a"]) is None and C.nth_key(df, 0, ["a"]) is None
    marked = C.mark_cap(df, 700, ["a", "b", "c"])
    assert marked.filter("within_cap").count() == sum(key(r) <= key(want[699]) for r in rows)
    assert not C.mark_cap(df, 0, ["a"]).filter("within_cap").count()
    df.unpersist()
