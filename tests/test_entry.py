"""Driver contract and a streaming run equal to the batch result."""

import importlib.util
import os

from pyspark.sql import functions as F

from shopsight.plans import common
from shopsight.sources import testdata as td
from shopsight.sources.store import StarStore
from shopsight.streaming.ingest import ingest_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_stream_equals_batch(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    lines = td.table(spark, sf, "lineitem")
    stream = spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    store = StarStore(os.path.join(tmp_dir, "star"))
    q = ingest_stream(stream, store, os.path.join(tmp_dir, "ckpt"), common.SEQ,
                      to_feed=lambda b: td.feed_from_lines(spark, sf, b))
    q.awaitTermination()
    got = store.snapshot(spark).order_items.select("order_id", "product_code", "quantity").collect()
    exp = common.full_star(spark, sf).order_items.select("order_id", "product_code", "quantity").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exp))
    # a second run of the same query (same checkpoint) has nothing new to do
    q2 = ingest_stream(stream, store, os.path.join(tmp_dir, "ckpt"), common.SEQ,
                       to_feed=lambda b: td.feed_from_lines(spark, sf, b))
    q2.awaitTermination()
    assert store.snapshot(spark).order_items.count() == len(exp)
    assert F is not None


def test_entry_without_the_training_data_modules(monkeypatch):
    import sys
    m = _entry()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)       # as if it were not installed
    assert m._training_data() == ({}, {})
    assert "kpis_by_tenant" in m.queries() and "pipeline" not in m.queries()
