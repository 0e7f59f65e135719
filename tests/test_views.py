"""Views kept up to date by batch equal a full recompute and touch only what a batch touches."""

import os

import pytest
from pyspark.sql import functions as F

from shopsight.operators import kpi
from shopsight.plans import common, jobs
from shopsight.sources import testdata as td
from shopsight.sources import views as V
from shopsight.sources.store import StarStore

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _same(spark, store, views):
    star = store.snapshot(spark)
    assert _rows(views.customer_metrics(spark)) == _rows(kpi.rfm_metrics(star.orders, star.order_items))
    assert _rows(views.kpis(spark)) == _rows(kpi.kpis(star.order_items))


def _files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(base) for f in fs if f.startswith("part-")}


def test_views_equal_a_full_recompute_after_each_delivery(spark, tmp_dir):
    store, views = StarStore(f"{tmp_dir}/s", buckets=2), V.CustomerViews(f"{tmp_dir}/v", "year")
    assert views.customer_metrics(spark).count() == 0 and views.kpis(spark).count() == 0
    dirty = td.dirty_feed(spark, SF).persist()
    for batch, lines in ((0, 0), (1, 2), (2, 2), (1, 1)):        # batch 1 is put right by its second delivery
        jobs.load(td.batch_of(dirty, lines), store, batch, common.SEQ)
        views.refresh(spark, store, batch)
        _same(spark, store, views)
    dirty.unpersist()


_FEED = "tenant_id int, client string, sku string, qty int, price double, transaction_date string, n int"


def _deliver(spark, store, batch, rows):
    feed = spark.createDataFrame(rows, _FEED).withColumn("transaction_date", F.to_timestamp_ntz("transaction_date"))
    jobs.load(feed, store, batch, ["n"])


def test_only_touched_partitions_are_read_and_written(spark, tmp_dir):
    store, views = StarStore(f"{tmp_dir}/s", buckets=1), V.CustomerViews(f"{tmp_dir}/v")
    _deliver(spark, store, 0, [(1, "a", "x", 1, 2.0, "2024-01-05 10:00:00", 1), (1, "a", "y", 1, 3.0, "2024-02-05 10:00:00", 2)])
    views.refresh(spark, store, 0)
    january = {f: t for f, t in _files(f"{tmp_dir}/v/customers").items() if "2024-01" in f}
    # an order of February goes on in batch 1, and its day in March is new
    _deliver(spark, store, 1, [(1, "a", "z", 2, 1.0, "2024-02-05 10:00:00", 1), (1, "b", "z", 2, 1.0, "2024-03-01 00:00:00", 2)])
    views.refresh(spark, store, 1)
    _same(spark, store, views)
    assert {f: t for f, t in _files(f"{tmp_dir}/v/customers").items() if "2024-01" in f} == january
    read = views._parts(spark, {("2024-02", 0), ("2024-03", 0)})
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [period" in plan
    assert {r[0].split("period=")[1][:7] for r in read.select(F.input_file_name()).collect()} == {"2024-02", "2024-03"}
    # the batch comes again without March: that partition goes
    _deliver(spark, store, 1, [(1, "a", "z", 2, 1.0, "2024-02-05 10:00:00", 1)])
    views.refresh(spark, store, 1)
    _same(spark, store, views)
    assert not os.path.exists(f"{tmp_dir}/v/customers/period=2024-03/tenant_bucket=0")
    # and at last with nothing but a rejected line
    _deliver(spark, store, 1, [(1, "a", "z", 0, 1.0, "2024-02-05 10:00:00", 1)])
    views.refresh(spark, store, 1)
    _same(spark, store, views)


def test_a_refresh_that_is_broken_off_is_made_good(spark, tmp_dir, monkeypatch):
    store, views = StarStore(f"{tmp_dir}/s", buckets=1), V.CustomerViews(f"{tmp_dir}/v")
    _deliver(spark, store, 0, [(1, "a", "x", 1, 2.0, "2024-01-05 10:00:00", 1)])
    views.refresh(spark, store, 0)
    _deliver(spark, store, 0, [(1, "a", "x", 1, 2.0, "2024-05-05 10:00:00", 1)])
    with monkeypatch.context() as m:
        m.setattr(V.CustomerViews, "merge", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            views.refresh(spark, store, 0)
    views.refresh(spark, store, 0)                                # January is only known from the note
    _same(spark, store, views)
