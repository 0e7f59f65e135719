"""Frequent itemsets by vertical mining over all tenants at once.

Orders of a tenant are dealt over blocks of ``BLOCK`` orders, each with a place in its block,
and every (tenant, block, item) is one row of ``WORDS`` 64-bit words that say in which of the
block's orders the item is.  Level k holds the frequent sets of k items as such rows, keyed by
their first k - 1 items (the prefix) and the last one; two sets of one prefix join to a set
of k + 1 items whose words are the bitwise AND of theirs.  Bits are counted per block, summed
per set, and sets below the tenant's support go before the next level.

Nothing is kept on the driver but the number of sets a level has.  A tenant with a third of
all orders has a third of the blocks: joins are keyed by (tenant, block, prefix), and on the
second level, where all items of a tenant share the empty prefix, also by a salt of the left
item.  A very large order is one bit in each of its items' rows.  Blocks are cut inside shards of
about ``SHARD`` orders, so places are numbered in windows of bounded size.  Levels are written
to the shared scratch folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.operators.rfm import salted_join
from shopsight.session import staged

WORDS = 16
BLOCK = 64 * WORDS
SHARD = 16 * BLOCK
PAIR_SALTS = 16
BITS = [f"w{i}" for i in range(WORDS)]


def _count(words: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words]).cast("long")


def vertical(bk: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_orders, block, item, w0.., n): the orders of every block that hold the item."""
    sized = salted_join(bk.select(*keys, "order_id", "items"), counts, keys) if keys else bk.crossJoin(
        F.broadcast(counts))                                   # without keys: one row of counts
    shards = F.ceil(F.col("n_orders") / SHARD)
    sized = sized.withColumn("__shard", F.pmod(F.xxhash64("order_id"), shards))
    place = F.row_number().over(Window.partitionBy(*keys, "__shard").orderBy("order_id")) - 1
    # a shard has about SHARD orders; 2^20 blocks a shard never meet
    dealt = sized.withColumn("__at", place).select(
        *keys, "n_orders", (F.col("__shard") * (1 << 20) + F.floor(F.col("__at") / BLOCK)).alias("block"),
        (F.col("__at") % BLOCK).alias("__at"), F.explode("items").alias("item"))
    bit = F.expr("shiftleft(1L, CAST(__at % 64 AS INT))")
    words = [F.bit_or(F.when(F.floor(F.col("__at") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w)
             for i, w in enumerate(BITS)]
    return (dealt.groupBy(*keys, "n_orders", "block", "item").agg(*words)
            .withColumn("n", _count([F.col(w) for w in BITS])))


def _frequent(rows: DataFrame, keys: Sequence[str], min_support: float) -> DataFrame:
    """(keys, prefix, last, n_orders, freq) of the sets that reach the support of their key."""
    return (rows.groupBy(*keys, "prefix", "last", "n_orders").agg(F.sum("n").alias("freq"))
            .filter(F.col("freq") / F.col("n_orders") >= F.lit(min_support)))


def _joined(rows: DataFrame, keys: Sequence[str], first: bool) -> DataFrame:
    """Rows of the sets with one item more."""
    on = [*keys, "n_orders", "block", "prefix"]
    right = rows.select(*on, F.col("last").alias("__last"), *[F.col(w).alias(f"r{w}") for w in BITS])
    left = rows
    if first:
        salt = F.pmod(F.xxhash64("last"), F.lit(PAIR_SALTS))
        left = rows.withColumn("__salt", salt)
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1)).cast("array<bigint>")))
        on = [*on, "__salt"]
    both = [F.col(w).bitwiseAND(F.col(f"r{w}")) for w in BITS]
    pairs = left.drop("n").join(right, on).filter(F.col("last") < F.col("__last"))
    return (pairs.select(*keys, "n_orders", "block", F.concat("prefix", F.array("last")).alias("prefix"),
                         F.col("__last").alias("last"), *[b.alias(w) for b, w in zip(both, BITS)])
            .withColumn("n", _count([F.col(w) for w in BITS])).filter(F.col("n") > 0))


def frequent_itemsets(bk: DataFrame, min_support: float = 0.01, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Itemsets with support >= min_support per key, as (keys, items, n_items, freq, support, n_orders).

    ``support = freq / n_orders`` of the key, compared like the reference does (floating
    point ``>=``).  Orders are distinct within a key, items distinct within an order.
    """
    keys = list(keys)
    counts = bk.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orders")).filter("n_orders > 0")
    rows = staged(vertical(bk, counts, keys).select(
        *keys, "n_orders", "block", F.array().cast("array<string>").alias("prefix"), F.col("item").alias("last"),
        *BITS, "n"), "itemset-words")
    levels = []
    while True:
        level = staged(_frequent(rows, keys, min_support), "itemset-level")
        if levels and level.isEmpty():
            break
        levels.append(level)
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, "prefix", "last")]
        kept = rows.alias("l").join(level.alias("f"), same, "left_semi")
        rows = staged(_joined(kept, keys, len(levels) == 1), "itemset-words")
    found = reduce(DataFrame.unionByName, levels)
    return found.select(*keys, F.concat("prefix", F.array("last")).alias("items"),
                        (F.size("prefix") + 1).alias("n_items"), "freq",
                        (F.col("freq") / F.col("n_orders")).alias("support"), "n_orders")
