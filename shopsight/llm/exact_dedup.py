"""Exact dedup by skew-safe combining (operator 8).

1. Each map task merges its own equal texts (map-side combine keyed by the whole text).
2. Digest groups merge; a hot digest (more than ``rows / hot_share`` rows) is dealt over
   ``salts`` salts first, so no reducer sees more than a share of it.
3. The salt winners of hot digests are combined globally, again keyed by the whole text.

Every merge groups by (digest, text), so texts are equal only if their content is.  The
list of hot digests has at most ``hot_share`` rows by construction and is broadcast.  If
different texts share a digest (only with a weak digest), their rows are mapped back by
digest and text, all others by digest alone.

Defined cases: null text counts as the empty text; rows without doc_id count in
group_size, never win, and are not kept unless the whole group has no doc_id, when
keep_id is null and no row is marked as kept (``deduplicate`` leaves one of them, as no
other row has the text); equal rows with the same doc_id are all reported with the same
values (``deduplicate`` leaves one of them); an empty table gives no rows; extra columns are
ignored by ``classes`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import staged


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, digest=sha256, salts: int = 32, hot_share: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", "_text", digest(F.col("_text")).alias("digest"))
    total = rows.count()
    counts = rows.groupBy("digest").agg(F.count("*").alias("_n"))
    hot = staged(counts.filter(F.col("_n") * hot_share > F.lit(total)).filter("_n > 1")
                 .select("digest", F.lit(True).alias("_hot")), "hot-digests")
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)))

    # local combine (partial aggregate on the whole text), then one merge per salted group
    merged = (salted.groupBy("digest", "_salt", "_text")
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
                   F.first("_hot").alias("_hot")))
    winners = staged(merged.select("digest", "_salt", "keep_id", "group_size", "_hot",
                                   F.when(F.col("_hot"), F.col("_text")).alias("_text")), "salt-winners")
    combined = (winners.filter("_hot").groupBy("digest", "_text")
                .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))))
    cols = ["digest", F.col("_salt").cast("bigint").alias("_salt"), "keep_id", "group_size"]
    final = staged(combined.select(*cols).unionByName(winners.filter("_hot is null").select(*cols)), "winners")

    keyed = salted.withColumn("_salt", F.col("_salt").cast("bigint"))
    clash = final.groupBy("digest", "_salt").count().filter("count > 1").select("digest").distinct()
    clash = staged(clash, "clashes")
    if clash.isEmpty():
        out = keyed.drop("_text", "_hot").join(final, ["digest", "_salt"])
    else:
        by_text = (rows.join(clash, "digest", "left_semi").groupBy("digest", "_text")
                   .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        plain = (keyed.join(clash, "digest", "left_anti").drop("_text", "_hot")
                 .join(final, ["digest", "_salt"]))
        out = plain.drop("_salt").unionByName(
            rows.join(clash, "digest", "left_semi").join(by_text, ["digest", "_text"]).drop("_text"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest")


def deduplicate(docs: DataFrame, digest=sha256, **how) -> DataFrame:
    """The input rows that stay, one per distinct text, with all their columns."""
    kept = classes(docs, digest, **how).select("keep_id", "digest").distinct()
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__digest", digest(text))
    out = keyed.join(kept.select(F.col("keep_id").alias("__id"), F.col("digest").alias("__d")),
                     F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return out.dropDuplicates(["doc_id", "__digest"]).select(*[F.col(f"`{c}`") for c in names])
