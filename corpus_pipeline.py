"""Corpus pipeline: quality classifier, exact dedup, near-dedup, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` writes each stage as Parquet below the
shared checkpoint folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopsight.llm import exact_dedup, mixing, near_dedup, piece_codec, quality_pu
from shopsight.llm.common import staged, table
from shopsight.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mix", mix_stage), ("encode", encode_stage)]

ORACLE_SQL = None          # the classifier and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
