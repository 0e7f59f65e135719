"""Shared plan fragments for the query catalog (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopsight.operators import cleaning, kpi, rfm, star
from shopsight.session import staged
from shopsight.sources import testdata as td

SEQ = td.feed_sequence()
CLEAN_KEEP = ("tenant_id", "l_orderkey", "l_linenumber")


def clean_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_feed(td.feed(spark, sf_dir), keep=CLEAN_KEEP)


def clean_dirty_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_feed(td.dirty_feed(spark, sf_dir), keep=CLEAN_KEEP)


def full_star(spark: SparkSession, sf_dir: str) -> star.Star:
    """The star after one full load of the clean feed."""
    return star.star_from_clean(spark, clean_feed(spark, sf_dir), SEQ, td.tenants(spark, sf_dir))


def stored_star(spark: SparkSession, sf_dir: str) -> star.Star:
    """``full_star`` for plans that read several of its tables: the feed is joined and cleaned once."""
    return star.star_from_clean(spark, staged(clean_feed(spark, sf_dir), "clean-feed"), SEQ, td.tenants(spark, sf_dir))


def rfm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = full_star(spark, sf_dir)
    return kpi.rfm_metrics(s.orders, s.order_items)


def rfm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant_id, buyer_id, last_order_date, recency, frequency, monetary), raw values.

    One row per customer, read by every scaling / clustering / scoring branch:
    materialised once in the shared scratch folder instead of re-deriving it from the
    fact table in each branch; the metrics before, as recency reads them twice.
    """
    return staged(rfm.with_recency(staged(rfm_metrics(spark, sf_dir), "rfm-metrics")), "rfm-features")


def rfm_scaled(spark: SparkSession, sf_dir: str, weights: dict | None = None, feats: DataFrame | None = None) -> DataFrame:
    """Standardised (and optionally weighted) features; raw values kept as raw_*."""
    z = rfm.standardize(rfm_features(spark, sf_dir) if feats is None else feats, keep_raw=True)
    return rfm.weight(z, weights) if weights else z
