"""Star upkeep properties: batching does not change the tables, replays are no-ops."""

from pyspark.sql import functions as F

from shopsight.operators import cleaning, star as st
from shopsight.plans import common
from shopsight.sources import testdata as td
from shopsight.sources.store import StarStore

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def _load(spark, n_batches, replay=()):
    clean = common.clean_dirty_feed(spark, SF)
    s = st.Star.empty(spark, td.tenants(spark, SF))
    order = list(range(n_batches)) + list(replay)
    for b in order:
        s = st.load_batch(s, clean.filter(F.col("l_orderkey") % n_batches == b), b, common.SEQ)
    return s


def test_batching_gives_equal_tables(spark):
    one, three, seven = _load(spark, 1), _load(spark, 3), _load(spark, 7)
    for name, cols in [("customers", ["tenant_id", "customer_hash"]),
                       ("orders", ["order_id", "tenant_id", "customer_hash", "order_number"]),
                       ("order_items", ["order_id", "product_code", "quantity", "price"])]:
        a = _rows(getattr(one, name), cols)
        assert a == _rows(getattr(three, name), cols) == _rows(getattr(seven, name), cols)
    # last price wins in arrival order, whatever the batching (the sequence orders the batches here)
    assert _rows(one.tenants, ["tenant_id", "last_sync_date"]) == _rows(seven.tenants, ["tenant_id", "last_sync_date"])


def test_replay_is_idempotent(spark):
    base, replayed = _load(spark, 3), _load(spark, 3, replay=(1, 1))
    cols = ["order_id", "product_code", "quantity", "price", "batch_id"]
    assert _rows(base.order_items, cols) == _rows(replayed.order_items, cols)


def test_last_price_wins(spark):
    cur = spark.createDataFrame([(1, "A", 5.0)], "tenant_id int, product_code string, price double") \
        .withColumn("price", F.col("price").cast("decimal(18,4)"))
    batch = spark.createDataFrame([(1, "A", 7.0, 1), (1, "A", 6.0, 2), (1, "B", 1.0, 1)],
                                  "tenant_id int, product_code string, price double, seq int") \
        .withColumn("price", F.col("price").cast("decimal(18,4)"))
    got = {r.product_code: float(r.price) for r in st.upsert_products(cur, batch, ["seq"]).collect()}
    assert got == {"A": 6.0, "B": 1.0}


def test_unknown_tenant_key_rejected(spark):
    tenants = spark.createDataFrame([(1, "Acme", "key_1", None)], td.tenants(spark, SF).schema)
    feed = spark.createDataFrame([("key_1", "c"), ("key_x", "d"), (None, "e")], "tenant_key string, client string")
    acc, rej = st.resolve_tenant(feed, tenants)
    assert [r.client for r in acc.collect()] == ["c"]
    assert sorted(r.client for r in rej.collect()) == ["d", "e"]


def test_store_snapshot_matches_memory(spark, tmp_dir):
    clean = common.clean_dirty_feed(spark, SF)
    store = StarStore(tmp_dir)
    for b in (0, 1, 2, 1):
        store.write_batch(td.batch_of(clean, b), b, common.SEQ, load_time="2024-01-01 00:00:00")
    snap = store.snapshot(spark, td.tenants(spark, SF))
    mem = _load(spark, 3)
    for name, cols in [("customers", ["tenant_id", "customer_hash"]),
                       ("products", ["tenant_id", "product_code", "price"]),
                       ("orders", ["order_id", "tenant_id", "transaction_date", "order_number"]),
                       ("order_items", ["order_id", "product_code", "quantity", "price", "batch_id"])]:
        assert _rows(getattr(snap, name), cols) == _rows(getattr(mem, name), cols), name
    assert cleaning.source_count(snap.order_items).first().rows == mem.order_items.count()


def test_marker_modes(spark):
    import datetime as dt
    tenants = spark.createDataFrame([(1, "A", "key_1", None), (2, "B", "key_2", dt.datetime(2020, 1, 1))],
                                    td.tenants(spark, SF).schema)
    batch = spark.createDataFrame([(1, dt.datetime(2021, 5, 1)), (1, dt.datetime(2021, 6, 1))],
                                  "tenant_id int, transaction_date timestamp_ntz")
    ev = {r.tenant_id: r.last_sync_date for r in st.update_marker(tenants, batch, "event").collect()}
    assert ev == {1: dt.datetime(2021, 6, 1), 2: dt.datetime(2020, 1, 1)}   # untouched tenant keeps its marker
    ing = {r.tenant_id: r.last_sync_date for r in
           st.update_marker(tenants, batch, "ingest", now="2024-01-01 00:00:00").collect()}
    assert ing == {1: dt.datetime(2024, 1, 1), 2: dt.datetime(2020, 1, 1)}


# --- the store: redelivery, counters, scope ----------------------------------------------

CLEAN = ("tenant_id int, client_hash string, product_code string, quantity int, price decimal(18,4), "
         "order_date string, transaction_date timestamp_ntz, seq int")


def _clean(spark, *rows):
    """rows: (tenant, client, product, price, seq)."""
    import datetime as dt
    from decimal import Decimal
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t, c, p, 1, Decimal(x), "2024-01-01 00:00:00", day, s) for t, c, p, x, s in rows], CLEAN)


def _prices(star):
    return {(r.tenant_id, r.product_code): float(r.price) for r in star.products.collect()}


def test_redelivery_drops_tenants_that_are_gone(spark, tmp_dir):
    store = StarStore(tmp_dir)
    store.write_batch(_clean(spark, (1, "a", "A", 5, 1), (2, "b", "B", 6, 1)), 0, ["seq"])
    store.write_batch(_clean(spark, (1, "a", "A", 7, 1)), 0, ["seq"])
    s = store.snapshot(spark)
    assert [r.tenant_id for r in s.order_items.collect()] == [1] and _prices(s) == {(1, "A"): 7.0}
    assert [r.tenant_id for r in s.tenants.collect()] == [1]


def test_replay_keeps_the_last_price(spark, tmp_dir):
    store = StarStore(tmp_dir)
    store.write_batch(_clean(spark, (1, "a", "A", 10, 1), (1, "a", "C", 3, 1)), 1, ["seq"])
    store.write_batch(_clean(spark, (1, "a", "A", 20, 1)), 2, ["seq"])
    store.write_batch(_clean(spark, (1, "a", "A", 10, 1), (1, "a", "C", 4, 1)), 1, ["seq"])
    s = store.snapshot(spark)
    assert _prices(s) == {(1, "A"): 20.0, (1, "C"): 4.0}
    assert sorted((r.product_code, r.batch_id) for r in s.order_items.collect()) == [("A", 1), ("A", 2), ("C", 1)]
    assert {(r.batch_key, r.sent) for r in store.batches(spark).collect()} == {("load:1", 2), ("load:2", 1)}


def test_failed_delivery_leaves_other_batches_and_is_delivered_again(spark, tmp_dir):
    import pytest
    from pyspark.sql import functions as F
    store = StarStore(tmp_dir)
    store.write_batch(_clean(spark, (1, "a", "A", 5, 1)), 0, ["seq"])
    good = _clean(spark, (1, "z", "Z", 9, 1), (2, "z", "Z", 9, 1))
    bad = good.withColumn("quantity", F.when(F.col("tenant_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("quantity")))
    with pytest.raises(Exception, match="lost"):
        store.write_batch(bad, 1, ["seq"])
    s = store.snapshot(spark)
    assert s.customers.count() == 1 and s.orders.count() == 1 and s.order_items.count() == 1
    store.write_batch(good, 1, ["seq"])
    assert store.snapshot(spark).order_items.count() == 3


def test_counters_come_from_the_write(spark, tmp_dir):
    """One pass: the feed's rows are computed once, for the lines and the counters."""
    import datetime as dt

    from shopsight.plans import jobs
    rows = [(t, f"c{t}" if q else None, "S", q, 2.0, dt.datetime(2024, 1, 1), 1) for t in (1, 2) for q in (0, 3, 4)]
    feed = spark.createDataFrame(rows, "tenant_id int, client string, sku string, qty int, price double, "
                                       "transaction_date timestamp_ntz, seq int")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store = StarStore(tmp_dir)
    jobs.load(feed.mapInArrow(count, feed.schema), store, 0, ["seq"])
    assert seen.value == len(rows)
    n = store.batches(spark).first()
    assert (n.processed, n.sent, n.filtered, n.unknown_key) == (6, 4, 2, 0)


def test_tenant_scope_reads_one_bucket(spark, tmp_dir):
    store = StarStore(tmp_dir)
    store.write_batch(_clean(spark, *[(t, "a", "A", t, 1) for t in range(1, 30)]), 0, ["seq"])
    s = store.snapshot(spark, tenant_id=7)
    assert _prices(s) == {(7, "A"): 7.0} and s.orders.count() == 1
    assert len(s.orders.inputFiles()) < len(store.snapshot(spark).orders.inputFiles()) or "tenant_bucket" in \
        s.orders._jdf.queryExecution().toString()


def test_new_stream_checkpoint_leaves_old_batches(spark, tmp_dir):
    import os

    from shopsight.streaming.ingest import ingest_stream
    store = StarStore(os.path.join(tmp_dir, "star"))
    store.write_batch(_clean(spark, (1, "a", "A", 5, 1)), 0, ["seq"])
    lines = "tenant_id int, client string, sku string, qty int, price double, transaction_date timestamp_ntz, seq int"
    import datetime as dt
    for k in (1, 2):
        folder = os.path.join(tmp_dir, f"in{k}")
        spark.createDataFrame([(1, f"c{k}", "S", k, 2.0, dt.datetime(2024, 1, k), 1), (1, None, "S", 1, 2.0, None, 1)],
                              lines).coalesce(1).write.parquet(folder)
        stream = spark.readStream.schema(lines).parquet(folder)
        ingest_stream(stream, store, os.path.join(tmp_dir, f"ck{k}"), ["seq"]).awaitTermination()
    assert store.snapshot(spark).order_items.count() == 3
    log = sorted((r.processed, r.sent, r.filtered) for r in store.batches(spark).collect())
    assert log == [(1, 1, 0), (2, 1, 1), (2, 1, 1)]


def test_late_and_repeated_rows_of_a_delta_load(spark, tmp_dir):
    import datetime as dt

    from shopsight.plans import jobs
    schema = "tenant_id int, client string, sku string, qty int, price double, transaction_date timestamp_ntz, seq int"
    day = lambda d: dt.datetime(2024, 1, d)
    first = [(1, "a", "A", 1, 2.0, day(1), 1), (1, "a", "A", 1, 2.0, day(5), 1), (1, "a", "A", 1, 2.0, day(5), 1),
             (1, None, "A", 1, 2.0, day(5), 1)]
    late = [(1, "a", "A", 1, 2.0, day(5), 1),             # a third copy of a stored row, at the marker's own time
            (1, "b", "B", 2, 3.0, day(4), 2), (2, "c", "C", 1, 1.0, day(5), 3)]
    new = [(1, "a", "A", 1, 2.0, day(6), 1)] * 2
    store = StarStore(tmp_dir)
    jobs.load(spark.createDataFrame(first, schema), store, 0, ["seq"])
    for _ in range(2):                                       # delivered twice
        jobs.load(spark.createDataFrame(first + late + new, schema), store, 1, ["seq"], mode="delta",
                  marker="2024-01-05 00:00:00", overlap="2 days")
        got = sorted((r.tenant_id, r.product_code, r.quantity, r.transaction_date.day)
                     for r in store.snapshot(spark).order_items.collect())
        assert got == sorted((r[0], r[2], r[3], r[5].day) for r in first + late + new if r[1])
    nothing = jobs.load(spark.createDataFrame([], schema), store, 2, ["seq"], mode="delta",
                        marker="2024-01-05 00:00:00", overlap="2 days")
    assert nothing.count() == 0 and store.snapshot(spark).order_items.count() == 8
