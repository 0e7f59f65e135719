"""Mixing sources to target weights (operator 2), DataFrame functions only.

Targets: every source gets a share of all words by weight, stopping at ``max_epochs``
times its own words; the excess goes to the others by weight.  That is one water level:
``target = least(cap, level * weight)`` with the level found from running sums over the
sources ordered by ``cap / weight``.

Selection: Efraimidis-Spirakis keys ``-ln(u) / quality`` (u from the md5 of the document
id), so better documents tend to come first.  ``floor(target / words)`` complete epochs
take every document; the rest of the budget goes down the key order.

Scale: the prefix sum of a source is never one task.  Rows are dealt over ``buckets`` key
ranges per source, bucket totals (at most ``buckets`` rows a source) are summed up in
order, and each bucket sums its own rows from there.  Texts are read once, for their size
and quality; after that one shuffle of (id, source, size, key) rows.

Defined cases: null text has size 0 and takes 0; the null source is a source of its own,
last in order; a null doc_id gets the key of the empty string; repeated ids are separate
rows, ordered by (key, id, size) and, if all agree, sharing one interval arbitrarily; an
empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm.common import staged

SYMBOLS = "#*$%&|<>"
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks: blanks become single spaces, which
    are counted by length, so no word is ever built."""
    for blank in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    flat = F.trim(F.regexp_replace(text, " {2,}", " "))
    gaps = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(F.length(flat) > 0, gaps + 1).otherwise(0).cast("bigint")


def quality(text: Column, size: Column) -> Column:
    """1 for clean prose, falling with the symbols per word, 0.05 at least."""
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, F.greatest(F.lit(0.05), 1 - marks / size)).otherwise(F.lit(0.05))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A reproducible number in (0, 1) from 52 bits of the id's md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).  One row per source: the
    windows below sort a table as small as the list of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(order) - 1) % len(weights) + 1)
    s = (sizes.withColumn("weight", weight)
         .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
         .withColumn("all_weight", F.sum("weight").over(every))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    # the first source in ratio order that its level leaves under its cap sets the level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return s.select("source", "source_size",
                    F.when(level.isNull(), F.col("cap"))
                     .otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3,
        buckets: int = 1024, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_key) for every row of (doc_id, text,
    source); ``text_key`` names its text."""
    size, quality_of = F.col("size"), quality(F.col("text"), F.col("size"))
    read = docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("size"))
    weighed = staged(read.select("doc_id", "source", size, quality_of.alias("quality"),
                                 F.xxhash64("text").alias("text_key")), "mix-sizes")   # texts are read once
    rows = (weighed.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("quality"))
            .select("doc_id", "source", "size", "key", "text_key",
                    F.floor(F.lit(buckets) * F.col("key") / (1 + F.col("key"))).alias("bucket")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")),
                   weights, share, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = (starts.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
              .select(F.col("b.source").alias("_source"), F.col("b.bucket").alias("_bucket"), "before",
                      "source_size", "target"))
    joined = rows.join(starts, rows["source"].eqNullSafe(starts["_source"])
                       & (rows["bucket"] == starts["_bucket"]))
    inside = (Window.partitionBy("_source", "_bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor(F.col("target") - epochs * F.col("source_size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         "text_key")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each input row repeated as whole copies, ``taken / size`` rounded
    to the nearest (the document at a budget's edge is taken if half of it is owed).

    Rows are known by id, text and source.  Rows that agree in all three share the copies that
    were worked out for them: each has the same number and one of them what is left over."""
    names = docs.columns
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    plan = staged(mix(docs, **how).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
                                           F.col("source").alias("__source"))
                  .agg(F.sum(copies.cast("bigint")).alias("__n"), F.count("*").alias("__rows")).filter("__n > 0"), "mix-plan")
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
            & F.col("source").eqNullSafe(F.col("__source")))
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    each = F.floor(F.col("__n") / F.col("__rows"))
    out = keyed.join(plan.filter(each > 0), same).withColumn("__times", each)
    over = plan.filter(F.col("__n") % F.col("__rows") > 0)
    if not over.isEmpty():
        out = out.unionByName(keyed.join(over, same).dropDuplicates(["__id", "__key", "__source"])
                              .withColumn("__times", F.col("__n") % F.col("__rows")))
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__times")))
            .select(*[F.col(f"`{c}`") for c in names]))
