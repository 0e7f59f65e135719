"""Market-basket queries.

Transactions for mining: order = l_orderkey, item = p_brand, tenant = customer
nation.  Parameters: min_support 0.002, min_confidence 0.01 (low enough that
rules with multi-item consequents occur); all products take part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsight.functions.scalar import ITEM_SEP, label_side, percent, fixed
from shopsight.operators import basket as bk
from shopsight.plans import common
from shopsight.plans import sql as S
from shopsight.plans.catalog import query
from shopsight.session import staged
from shopsight.sources import testdata as td

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.01
TOP_N_SMALL = 10
CHART_N = 300
RANGE = (0.02, 0.005, 0.3, 0.8)   # support bounds given swapped on purpose


# --- Spark side -----------------------------------------------------------------

def brand_baskets(spark, sf_dir):
    return bk.baskets(td.brand_transactions(spark, sf_dir))


def stored_baskets(spark, sf_dir):
    """The baskets for mining, which counts them, deals them out and sums them up: computed once."""
    return staged(brand_baskets(spark, sf_dir), "baskets")


def brand_itemsets(spark, sf_dir):
    return bk.frequent_itemsets(stored_baskets(spark, sf_dir), MIN_SUPPORT)


def brand_rules(spark, sf_dir):
    return bk.rounded_rules(bk.association_rules(brand_itemsets(spark, sf_dir), MIN_CONFIDENCE))


def _rule_text(df):
    return df.select("tenant_id", F.array_join("antecedent", ITEM_SEP).alias("antecedent"),
                     F.array_join("consequent", ITEM_SEP).alias("consequent"),
                     "support", "confidence", "lift")


# --- SQL side ---------------------------------------------------------------------

TX_SQL = """
tx AS (
  SELECT c.c_nationkey AS tenant_id, CAST(l.l_orderkey AS VARCHAR) AS order_id,
         p.p_brand AS product_code
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey),
cnt AS (SELECT tenant_id, product_code, count(*) AS n FROM tx GROUP BY tenant_id, product_code),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, product_code) AS INTEGER) AS rank
  FROM cnt)"""


def _mining_sql(min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> str:
    return TX_SQL + f""",
bi AS (SELECT DISTINCT tenant_id, order_id, product_code AS item FROM tx WHERE product_code IS NOT NULL),
nord AS (SELECT tenant_id, count(DISTINCT order_id) AS n_orders FROM bi GROUP BY tenant_id),
sub(tenant_id, order_id, items, last) AS (
  SELECT tenant_id, order_id, [item], item FROM bi
  UNION ALL
  SELECT s.tenant_id, s.order_id, list_append(s.items, b.item), b.item
  FROM sub s JOIN bi b ON s.tenant_id = b.tenant_id AND s.order_id = b.order_id AND b.item > s.last),
fi AS (SELECT tenant_id, items, count(*) AS freq FROM sub GROUP BY tenant_id, items),
fis AS (
  SELECT f.tenant_id, f.items, CAST(len(f.items) AS INTEGER) AS n_items, f.freq,
         CAST(f.freq AS DOUBLE) / n.n_orders AS support, n.n_orders
  FROM fi f JOIN nord n ON f.tenant_id = n.tenant_id
  WHERE CAST(f.freq AS DOUBLE) / n.n_orders >= {min_support}),
masks AS (
  SELECT tenant_id, items, support, unnest(generate_series(1, (1 << n_items) - 2)) AS mask
  FROM fis WHERE n_items >= 2),
cand AS (
  SELECT tenant_id, support,
         list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS antecedent,
         list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 0) AS consequent
  FROM masks),
rules_raw AS (
  SELECT m.tenant_id, m.antecedent, m.consequent, m.support,
         m.support / a.support AS confidence, (m.support / a.support) / c.support AS lift
  FROM cand m
  JOIN fis a ON a.tenant_id = m.tenant_id AND a.items = m.antecedent
  JOIN fis c ON c.tenant_id = m.tenant_id AND c.items = m.consequent),
rules AS (
  SELECT tenant_id, antecedent, consequent, {S.rnd('support', 4)} AS support,
         {S.rnd('confidence', 4)} AS confidence, {S.rnd('lift', 4)} AS lift
  FROM rules_raw WHERE confidence >= {min_confidence})"""


def with_rec(ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + body


_RULES_TXT = ("tenant_id, array_to_string(antecedent, ', ') AS antecedent, "
              "array_to_string(consequent, ', ') AS consequent, support, confidence, lift")


# --- queries ----------------------------------------------------------------------

@query("transactions", covers="A6 C9",
       sql=S.with_(S.STAR_ITEMS, "SELECT tenant_id, order_id, product_code FROM items"))
def transactions(spark, sf_dir):
    return bk.transactions(common.stored_star(spark, sf_dir))


@query("item_counts", covers="D6",
       sql=S.with_(TX_SQL, "SELECT tenant_id, product_code, n FROM cnt"))
def item_counts(spark, sf_dir):
    return bk.item_counts(td.brand_transactions(spark, sf_dir))


@query("top_items", covers="E5",
       sql=S.with_(TX_SQL, f"SELECT tenant_id, product_code, n, rank FROM ranked WHERE rank <= {TOP_N_SMALL}"))
def top_items(spark, sf_dir):
    return bk.top_items(td.brand_transactions(spark, sf_dir), TOP_N_SMALL)


@query("top_item_rows", covers="C10",
       sql=S.with_(TX_SQL, f"""SELECT tx.tenant_id, tx.order_id, tx.product_code FROM tx
JOIN (SELECT * FROM ranked WHERE rank <= {TOP_N_SMALL}) r
  ON tx.tenant_id = r.tenant_id AND tx.product_code = r.product_code"""))
def top_item_rows(spark, sf_dir):
    return bk.keep_top_items(td.brand_transactions(spark, sf_dir), TOP_N_SMALL)


@query("baskets", covers="D5",
       sql=S.with_(TX_SQL, """
SELECT tx.tenant_id, tx.order_id, array_to_string(list_sort(list_distinct(list(tx.product_code))), ', ')
       AS items, CAST(len(list_distinct(list(tx.product_code))) AS INTEGER) AS n_items
FROM tx WHERE tx.product_code IS NOT NULL GROUP BY tx.tenant_id, tx.order_id"""))
def baskets(spark, sf_dir):
    b = brand_baskets(spark, sf_dir)
    return b.select("tenant_id", "order_id", F.array_join("items", ITEM_SEP).alias("items"),
                    F.size("items").alias("n_items"))


@query("itemsets", covers="G8",
       sql=with_rec(_mining_sql(), """SELECT tenant_id, array_to_string(items, ', ') AS items,
n_items, freq, support FROM fis"""))
def itemsets(spark, sf_dir):
    i = brand_itemsets(spark, sf_dir)
    return i.select("tenant_id", F.array_join("items", ITEM_SEP).alias("items"), "n_items", "freq",
                    "support")


@query("rules", covers="G9 E6 F5", sql=with_rec(_mining_sql(), f"SELECT {_RULES_TXT} FROM rules"))
def rules(spark, sf_dir):
    return _rule_text(brand_rules(spark, sf_dir).orderBy(*bk.rule_order()))


@query("rules_top_lift", covers="E7 B14",
       sql=with_rec(_mining_sql(), f"""SELECT tenant_id, label, support, confidence, lift, rank, lift_class
FROM (SELECT *, array_to_string(antecedent, ', ') || ' -> ' || array_to_string(consequent, ', ') AS label,
             CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY lift DESC, confidence DESC,
               array_to_string(antecedent, ', '), array_to_string(consequent, ', ')) AS INTEGER) AS rank,
             CASE WHEN lift > 2 THEN 'target' ELSE 'background' END AS lift_class
      FROM rules) WHERE rank <= {CHART_N}"""))
def rules_top_lift(spark, sf_dir):
    c = bk.rule_chart(brand_rules(spark, sf_dir), CHART_N)
    return c.select("tenant_id", "label", "support", "confidence", "lift", "rank", "lift_class")


@query("rules_lift_class", covers="B14",
       sql=with_rec(_mining_sql(), f"""SELECT {_RULES_TXT},
  CASE WHEN lift > 2 THEN 'target' ELSE 'background' END AS lift_class FROM rules"""))
def rules_lift_class(spark, sf_dir):
    r = bk.classify_lift(brand_rules(spark, sf_dir))
    return r.select("tenant_id", F.array_join("antecedent", ITEM_SEP).alias("antecedent"),
                    F.array_join("consequent", ITEM_SEP).alias("consequent"),
                    "support", "confidence", "lift", "lift_class")


@query("rules_in_range", covers="B15",
       sql=with_rec(_mining_sql(), f"""SELECT {_RULES_TXT} FROM rules
WHERE support BETWEEN {min(RANGE[:2])} AND {max(RANGE[:2])}
  AND confidence BETWEEN {min(RANGE[2:])} AND {max(RANGE[2:])}"""))
def rules_in_range(spark, sf_dir):
    return _rule_text(bk.rules_in_range(brand_rules(spark, sf_dir), *RANGE))


@query("basket_summary", covers="D9",
       sql=with_rec(_mining_sql(), """SELECT n.tenant_id, n.n_orders AS total_orders,
coalesce(r.rules_found, 0) AS rules_found
FROM nord n LEFT JOIN (SELECT tenant_id, count(*) AS rules_found FROM rules GROUP BY tenant_id) r
  ON n.tenant_id = r.tenant_id"""))
def basket_summary(spark, sf_dir):
    b = stored_baskets(spark, sf_dir)
    r = bk.association_rules(bk.frequent_itemsets(b, MIN_SUPPORT), MIN_CONFIDENCE)
    return bk.basket_summary(b, r)


def _fixed_sql(v: str, d: int) -> str:
    return f"CAST(CAST({S.rnd(v, d)} AS DECIMAL(38,{d})) AS VARCHAR)"


@query("rule_display", covers="F2 F3 F4",
       sql=with_rec(_mining_sql(), f"""SELECT tenant_id, label,
  split_part(label, ' -> ', 1) AS side_a, split_part(label, ' -> ', 2) AS side_b,
  {_fixed_sql('support * 100', 2)} || '%' AS support_pct,
  {_fixed_sql('confidence * 100', 1)} || '%' AS confidence_pct,
  {_fixed_sql('lift', 2)} AS lift_text
FROM (SELECT *, array_to_string(antecedent, ', ') || ' -> ' || array_to_string(consequent, ', ') AS label
      FROM rules)"""))
def rule_display(spark, sf_dir):
    r = brand_rules(spark, sf_dir)
    lab = F.concat(F.array_join("antecedent", ITEM_SEP), F.lit(" -> "), F.array_join("consequent", ITEM_SEP))
    r = r.withColumn("label", lab)
    return r.select("tenant_id", "label", label_side("label", 0).alias("side_a"),
                    label_side("label", 1).alias("side_b"),
                    percent("support", 2).alias("support_pct"),
                    percent("confidence", 1).alias("confidence_pct"),
                    fixed("lift", 2).alias("lift_text"))
