"""Market-basket operators.

* Baskets are ``collect_set`` arrays per order (bounded by the order size), not
  a dense order x product matrix.
* Top-N items per tenant are taken in two steps: the n best of each (tenant, salt)
  share of the products, then the n best of those, so one tenant's products are
  never sorted in one task.  No product is cut unless the caller asks for it.
* Frequent itemsets are mined vertically, all tenants together (``itemsets``).
* Rules grow their consequents an item at a time: only splits that reach the
  confidence are extended (a larger consequent never has a higher one), and the
  supports of both sides are looked up with equi-joins on the sorted item arrays.
  There is no limit on the size of an itemset.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP, rule_label
from shopsight.operators.cleaning import for_tenant
from shopsight.operators.itemsets import frequent_itemsets  # noqa: F401  (G8)

SALTS = 32


# --- A6 / C9: transactions --------------------------------------------------------

def transactions(star, tenant_id: int | None = None) -> DataFrame:
    """(tenant_id, order_id, product_code) per line item of orders and products that exist."""
    items = for_tenant(star.order_items, tenant_id)
    orders = for_tenant(star.orders, tenant_id).select("tenant_id", "order_id")
    products = for_tenant(star.products, tenant_id).select("tenant_id", "product_code")
    return (items.join(orders, ["tenant_id", "order_id"], "left_semi")
                 .join(products, ["tenant_id", "product_code"], "left_semi")
                 .select("tenant_id", "order_id", "product_code"))


# --- D6 / E5 / C10: popularity ----------------------------------------------------

def item_counts(tx: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    return tx.groupBy(*keys, "product_code").agg(F.count(F.lit(1)).alias("n"))


def top_items(tx: DataFrame, n: int, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """The n most frequent products per key (ties: product code ascending)."""
    order = [F.col("n").desc(), F.col("product_code")]
    share = Window.partitionBy(*keys, "__salt").orderBy(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (item_counts(tx, keys).withColumn("__salt", F.pmod(F.xxhash64("product_code"), F.lit(SALTS)))
            .withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= n)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("__salt"))


def keep_top_items(tx: DataFrame, n: int | None, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Rows of the n most frequent products per key; all rows without ``n``."""
    if n is None:
        return tx
    top = top_items(tx, n, keys).select(*keys, "product_code")
    return tx.join(top, [*keys, "product_code"], "left_semi")


# --- D5: baskets --------------------------------------------------------------------

def baskets(tx: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """One row per order with its sorted distinct items; orders without items drop out."""
    b = tx.filter(F.col("product_code").isNotNull()).groupBy(*keys, "order_id").agg(
        F.sort_array(F.collect_set("product_code")).alias("items"))
    return b


def order_counts(bk: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    return bk.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orders"))


# --- G9 / E6: association rules ---------------------------------------------------------------

def association_rules(itemsets: DataFrame, min_confidence: float = 0.5,
                      keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Every rule A -> C with A, C non-empty, A + C a frequent itemset and
    confidence >= min_confidence; support, confidence and lift as in mlxtend.

    Level m holds the rules whose consequent has m items; level m + 1 extends a
    consequent by a later item of the same itemset.  A branch below the confidence
    is not extended, so a large itemset costs as many rows as it has rules.
    """
    from shopsight.session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(itemsets.sparkSession)
    biggest = itemsets.agg(F.max("n_items")).first()[0] or 0
    sup = itemsets.select(*keys, "items", "support")
    left = sup.select(*keys, F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    right = sup.select(*keys, F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    level = itemsets.filter(F.col("n_items") >= 2).select(
        *keys, "items", "support", F.array().cast("array<string>").alias("consequent"))
    levels = []
    for size in range(1, biggest):
        last = F.try_element_at("consequent", F.lit(-1))
        later = F.filter("items", lambda x: last.isNull() | (x > last))
        grown = (level.filter(F.size("items") > size)
                 .select(*keys, "items", "support", "consequent", F.explode(later).alias("__x"))
                 .select(*keys, "items", "support", F.concat("consequent", F.array("__x")).alias("consequent"))
                 .withColumn("antecedent", F.array_except("items", "consequent")))
        level = (grown.join(left, [*keys, "antecedent"])
                 .withColumn("confidence", F.col("support") / F.col("antecedent_support"))
                 .filter(F.col("confidence") >= F.lit(min_confidence)).checkpoint())
        levels.append(level)
        if size + 1 < biggest and level.isEmpty():
            break
    if not levels:
        levels = [level.withColumns({"antecedent": F.col("consequent"), "antecedent_support": F.col("support"),
                                     "confidence": F.col("support")}).filter("false")]
    rules = levels[0].select(*keys, "antecedent", "consequent", "antecedent_support", "support", "confidence")
    for more in levels[1:]:
        rules = rules.unionByName(more.select(*rules.columns))
    return (rules.join(right, [*keys, "consequent"])
            .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
            .select(*keys, "antecedent", "consequent", "antecedent_support", "consequent_support",
                    "support", "confidence", "lift"))


def rounded_rules(rules: DataFrame, digits: int = 4) -> DataFrame:
    """Report form of rules: support, confidence and lift rounded."""
    return (rules.withColumn("support", F.round("support", digits))
                 .withColumn("confidence", F.round("confidence", digits))
                 .withColumn("lift", F.round("lift", digits)))


def rule_order() -> list:
    """Rules by confidence descending; ties by the item lists."""
    return [F.col("confidence").desc(), F.array_join("antecedent", ITEM_SEP),
            F.array_join("consequent", ITEM_SEP)]


# --- B14 / E7 / B15: chart data ----------------------------------------------------------------

def classify_lift(rules: DataFrame, cut: float = 2.0) -> DataFrame:
    return rules.withColumn("lift_class", F.when(F.col("lift") > cut, "target").otherwise("background"))


def rule_chart(rules: DataFrame, n: int, keys: Sequence[str] = ("tenant_id",),
               cut: float = 2.0) -> DataFrame:
    """The n rules with the highest lift per key, split into target / background."""
    w = Window.partitionBy(*keys).orderBy(
        F.col("lift").desc(), F.col("confidence").desc(),
        F.array_join("antecedent", ITEM_SEP), F.array_join("consequent", ITEM_SEP))
    top = rules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return classify_lift(top.withColumn("label", rule_label("antecedent", "consequent")), cut)


def rules_in_range(rules: DataFrame, s0: float, s1: float, c0: float, c1: float) -> DataFrame:
    """Support in [s0, s1] and confidence in [c0, c1]; swapped bounds are exchanged and
    an empty range (equal bounds) means no filter, as in the zoom of the reference."""
    if s0 == s1 or c0 == c1:
        return rules
    lo_s, hi_s = sorted((s0, s1))
    lo_c, hi_c = sorted((c0, c1))
    return rules.filter(F.col("support").between(lo_s, hi_s) & F.col("confidence").between(lo_c, hi_c))


# --- D9 / B16: summary and guards -------------------------------------------------------------

def basket_summary(bk: DataFrame, rules: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    found = rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("rules_found"))
    return (order_counts(bk, keys).withColumnRenamed("n_orders", "total_orders")
            .join(found, list(keys), "left")
            .withColumn("rules_found", F.coalesce(F.col("rules_found"), F.lit(0))))
