"""DuckDB twins of the testdata adapters and of the cleaning / star steps.

Each constant is a list of CTE definitions (``name AS (...)``) that oracle
statements chain with ``WITH``.  They mirror ``shopsight.sources.testdata`` and
the operators, written independently in plain SQL.
"""

FEED = """
feed AS (
  SELECT c.c_nationkey AS tenant_id,
         'key_' || CAST(c.c_nationkey AS VARCHAR) AS tenant_key,
         c.c_name AS client,
         'SKU-' || CAST(l.l_partkey AS VARCHAR) AS sku,
         p.p_brand AS brand,
         CAST(l.l_quantity AS INTEGER) AS qty,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price,
         o.o_orderdate AS transaction_date,
         l.l_orderkey, l.l_linenumber
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

DIRTY_FEED = FEED + """,
dirty AS (
  SELECT tenant_id, tenant_key,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL
              WHEN l_orderkey % 19 = 0 THEN '  '
              WHEN l_orderkey % 13 = 0 THEN ' ' || chr(9) || client || '  '
              ELSE client END AS client,
         CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE sku END AS sku,
         brand,
         CASE WHEN l_orderkey % 29 = 0 THEN '3.0'
              WHEN l_orderkey % 31 = 0 THEN '-2'
              WHEN l_orderkey % 37 = 0 THEN 'x'
              ELSE CAST(qty AS VARCHAR) END AS qty,
         CASE WHEN l_orderkey % 41 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE price END AS price,
         transaction_date, l_orderkey, l_linenumber
  FROM feed)"""


def classify(src: str) -> str:
    """Parsed columns and reject reason for a feed-shaped CTE ``src``."""
    return f"""
{src}_p AS (
  SELECT *,
         regexp_replace(CAST(client AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS c_txt,
         regexp_replace(CAST(sku AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS s_txt,
         CASE WHEN regexp_full_match(trim(CAST(qty AS VARCHAR)), '[+-]?[0-9]+')
              THEN TRY_CAST(trim(CAST(qty AS VARCHAR)) AS INTEGER) END AS q_val,
         CAST(price AS DECIMAL(18,4)) AS p_val,
         CAST(transaction_date AS TIMESTAMP) AS t_val
  FROM {src}),
{src}_c AS (
  SELECT *,
         CASE WHEN client IS NULL OR sku IS NULL OR price IS NULL THEN 'null_field'
              WHEN q_val IS NULL THEN 'bad_quantity'
              WHEN p_val IS NULL THEN 'bad_price'
              WHEN t_val IS NULL THEN 'null_date'
              WHEN c_txt = '' THEN 'empty_client'
              WHEN s_txt = '' THEN 'empty_sku'
              WHEN p_val <= 0 THEN 'price_not_positive'
              WHEN q_val <= 0 THEN 'quantity_not_positive'
         END AS reject_reason
  FROM {src}_p)"""


def clean(src: str, name: str = "clean") -> str:
    """Clean records of a feed-shaped CTE (``classify`` must precede)."""
    return f"""
{name} AS (
  SELECT tenant_id, l_orderkey, l_linenumber,
         sha256(c_txt) AS client_hash, s_txt AS product_code, q_val AS quantity,
         p_val AS price, strftime(t_val, '%Y-%m-%d %H:%M:%S') AS order_date,
         t_val AS transaction_date
  FROM {src}_c WHERE reject_reason IS NULL)"""


def with_order_id(src: str, name: str) -> str:
    """uuid5(DNS, 'tenant_<t>_<hash>_<date>') for each row of ``src``."""
    return f"""
{name}_d AS (
  SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8')
                 || encode('tenant_' || CAST(tenant_id AS VARCHAR) || '_' || client_hash
                           || '_' || order_date)) AS dg
  FROM {src}),
{name} AS (
  SELECT * EXCLUDE (dg),
         substr(dg, 1, 8) || '-' || substr(dg, 9, 4) || '-5' || substr(dg, 14, 3) || '-'
         || translate(substr(dg, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
         || substr(dg, 18, 3) || '-' || substr(dg, 21, 12) AS order_id
  FROM {name}_d)"""


# The star built from the clean feed in one load: items carry the order id.
CLEAN_FEED = FEED + "," + classify("feed") + "," + clean("feed")
STAR_ITEMS = CLEAN_FEED + "," + with_order_id("clean", "items")

# Order headers (one per id) of the star.
STAR = STAR_ITEMS + """,
star_orders AS (
  SELECT DISTINCT order_id, tenant_id, client_hash AS customer_hash, transaction_date
  FROM items)"""

RFM_METRICS = STAR + """,
rfm AS (
  SELECT i.tenant_id, i.client_hash AS buyer_id,
         max(o.transaction_date) AS last_order_date,
         count(DISTINCT i.order_id) AS frequency,
         CAST(sum(CAST(i.quantity * i.price AS DECIMAL(38,4))) AS DOUBLE) AS monetary
  FROM items i JOIN star_orders o ON i.order_id = o.order_id
  GROUP BY i.tenant_id, i.client_hash)"""

RFM_RECENCY = RFM_METRICS + """,
rfm_ref AS (
  SELECT tenant_id, max(last_order_date) + INTERVAL 1 DAY AS ref_date FROM rfm GROUP BY tenant_id),
rfm_r AS (
  SELECT r.tenant_id, r.buyer_id, r.last_order_date,
         date_sub('day', r.last_order_date, f.ref_date) AS recency,
         r.frequency, r.monetary
  FROM rfm r JOIN rfm_ref f ON r.tenant_id = f.tenant_id)"""

RFM_SCALED = RFM_RECENCY + """,
rfm_stats AS (
  SELECT tenant_id,
         avg(recency) AS mr, stddev_pop(recency) AS sr,
         avg(frequency) AS mf, stddev_pop(frequency) AS sf,
         avg(monetary) AS mm, stddev_pop(monetary) AS sm
  FROM rfm_r GROUP BY tenant_id),
rfm_z AS (
  SELECT r.tenant_id, r.buyer_id, r.recency AS raw_recency, r.frequency AS raw_frequency,
         r.monetary AS raw_monetary,
         (r.recency - s.mr) / CASE WHEN s.sr = 0 THEN 1 ELSE s.sr END AS recency,
         (r.frequency - s.mf) / CASE WHEN s.sf = 0 THEN 1 ELSE s.sf END AS frequency,
         (r.monetary - s.mm) / CASE WHEN s.sm = 0 THEN 1 ELSE s.sm END AS monetary
  FROM rfm_r r JOIN rfm_stats s ON r.tenant_id = s.tenant_id)"""


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding of a DOUBLE at its shortest decimal text (Spark's ``round``),
    instead of DuckDB's multiply-then-round."""
    return (f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body
