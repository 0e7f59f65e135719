"""Advice queries (H6-H9, F7) over the segment summary and the top-lift rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP, cluster_name_ua, fixed
from shopsight.operators import advice as ad
from shopsight.plans import q_basket, q_reports, q_segments
from shopsight.plans import sql as S
from shopsight.plans.catalog import query

BUSINESS = "електроніка"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _num_sql(v: str) -> str:
    return (f"regexp_replace(CAST(CAST({S.rnd(v, 2)} AS DECIMAL(38,2)) AS VARCHAR), "
            f"'(\\.\\d)0$', '\\1')")


def _segments(spark, sf_dir):
    s = q_segments.cluster_summary(spark, sf_dir)
    return s.withColumn("cluster_name", cluster_name_ua("cluster_id"))


def _pairs(spark, sf_dir):
    rules = q_basket.brand_rules(spark, sf_dir)
    return rules.select("tenant_id", F.array_join("antecedent", ITEM_SEP).alias("item_a"),
                      F.array_join("consequent", ITEM_SEP).alias("item_b"), "confidence",
                      fixed(F.col("confidence") * 100, 1).alias("confidence_pct"))


_SEG_SQL = q_reports._SUMMARY_SQL + """,
segs AS (SELECT *, 'Кластер ' || CAST(cluster_id AS VARCHAR) AS cluster_name FROM summ)"""

_PAIR_SQL = q_basket._mining_sql() + f""",
pairs AS (
  SELECT tenant_id, array_to_string(antecedent, ', ') AS item_a,
         array_to_string(consequent, ', ') AS item_b, confidence,
         CAST(CAST({S.rnd('confidence * 100', 1)} AS DECIMAL(38,1)) AS VARCHAR) AS confidence_pct
  FROM rules)"""

_ADVICE_CASE = f"""CASE WHEN contains(cluster_name, 'Champions') OR contains(cluster_name, '1') THEN {_lit(ad.ADVICE_TOP)}
  WHEN contains(cluster_name, 'Risk') OR contains(cluster_name, '3') THEN {_lit(ad.ADVICE_RISK)}
  ELSE {_lit(ad.ADVICE_DEFAULT)} END"""


@query("segment_advice", covers="H6 H9",
       sql=S.with_(_SEG_SQL, f"""SELECT tenant_id, cluster_id, cluster_name,
  {_lit(BUSINESS)} AS business_type, {_ADVICE_CASE} AS advice, true AS is_fallback FROM segs"""))
def segment_advice(spark, sf_dir):
    s = _segments(spark, sf_dir).select("tenant_id", "cluster_id", "cluster_name")
    # the same segment asked twice (two clicks) yields one advice row
    return ad.segment_advice(s.unionByName(s), business_type=BUSINESS)


@query("bundle_advice", covers="H7 H9",
       sql=q_basket.with_rec(_PAIR_SQL, f"""SELECT DISTINCT tenant_id, item_a, item_b, confidence,
  md5(printf({_lit(ad.BUNDLE_TEMPLATE)}, item_a, item_b)) AS advice_md5, true AS is_fallback FROM pairs"""))
def bundle_advice(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("tenant_id", "item_a", "item_b", "confidence")
    # a text of some 250 characters for each of all rules: shown by its digest
    return ad.bundle_advice(p).withColumn("advice_md5", F.md5("advice")).drop("advice")


_SEG_PROMPT_SQL = (f"printf({_lit(ad.SEGMENT_PROMPT)}, {_lit(BUSINESS)}, cluster_name, "
                   f"{_num_sql('recency')}, {_num_sql('frequency')}, {_num_sql('monetary')})")


@query("segment_prompt", covers="H8",
       sql=S.with_(_SEG_SQL, f"SELECT tenant_id, cluster_id, {_SEG_PROMPT_SQL} AS prompt FROM segs"))
def segment_prompt(spark, sf_dir):
    return ad.segment_prompt(_segments(spark, sf_dir), BUSINESS).select("tenant_id", "cluster_id", "prompt")


@query("bundle_prompt", covers="H8",
       sql=q_basket.with_rec(_PAIR_SQL, f"""SELECT tenant_id, item_a, item_b,
  md5(printf({_lit(ad.BUNDLE_PROMPT)}, {_lit(BUSINESS)}, item_a, item_b, confidence_pct)) AS prompt_md5 FROM pairs"""))
def bundle_prompt(spark, sf_dir):
    p = ad.bundle_prompt(_pairs(spark, sf_dir), BUSINESS)
    return p.select("tenant_id", "item_a", "item_b", F.md5("prompt").alias("prompt_md5"))


@query("advice_clean", covers="F7",
       sql=S.with_(_SEG_SQL, f"""SELECT tenant_id, cluster_id,
  trim(replace(replace(replace(replace(regexp_replace({_SEG_PROMPT_SQL}, '^\\s+|\\s+$', '', 'g'),
    '**', ''), '*', ''), '•', ''), chr(10), ' ')) AS clean_text FROM segs"""))
def advice_clean(spark, sf_dir):
    p = ad.segment_prompt(_segments(spark, sf_dir), BUSINESS)
    return ad.clean_text(p, "prompt").select("tenant_id", "cluster_id", "clean_text")
