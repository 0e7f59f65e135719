"""Feed cleaning, projections and filters.

The record cleaner of the reference runs per row in Python; here it is one
projection of built-in expressions, so it runs inside generated code and every
check is visible to Catalyst.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions.scalar import marker_timestamp, order_date_text, strip_ws
from shopsight.schemas import MONEY
from shopsight.session import staged

CLEAN_COLUMNS = ("client_hash", "product_code", "quantity", "price", "order_date", "transaction_date")

# Reject reasons, in the order the reference checks a record.
REASONS = ("null_field", "bad_quantity", "bad_price", "null_date",
           "empty_client", "empty_sku", "price_not_positive", "quantity_not_positive")


def _parse_quantity(col: Column, dtype: T.DataType) -> Column:
    """``int(x)``: text must be an integer literal ('3.0' fails); numbers truncate."""
    if isinstance(dtype, T.StringType):
        return strip_ws(col).try_cast("int")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col), F.lit(None)).otherwise(col.try_cast("long")).try_cast("int")
    return col.try_cast("int")


def _parse_price(col: Column, dtype: T.DataType) -> Column:
    """``float(x)`` then money: text is parsed as a double; NaN and infinities are invalid."""
    if isinstance(dtype, T.DecimalType):
        return col.try_cast(MONEY)
    d = (strip_ws(col) if isinstance(dtype, T.StringType) else col).try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(ok, d.try_cast(MONEY))


def _parse_date(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return col.cast("timestamp_ntz")
    return F.try_to_timestamp(strip_ws(col)).cast("timestamp_ntz")


def classify_feed(df: DataFrame, client: str = "client", sku: str = "sku", qty: str = "qty",
                  price: str = "price", ts: str = "transaction_date") -> DataFrame:
    """Add parsed columns and ``reject_reason`` (NULL for a clean record)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    c_txt = strip_ws(F.col(client))
    s_txt = strip_ws(F.col(sku))
    q = _parse_quantity(F.col(qty), types[qty])
    p = _parse_price(F.col(price), types[price])
    d = _parse_date(F.col(ts), types[ts])
    out = (df.withColumn("__client", c_txt).withColumn("__sku", s_txt)
             .withColumn("__qty", q).withColumn("__price", p).withColumn("__ts", d))
    reason = (F.when(F.col(client).isNull() | F.col(sku).isNull() | F.col(price).isNull(), "null_field")
               .when(F.col("__qty").isNull(), "bad_quantity")
               .when(F.col("__price").isNull(), "bad_price")
               .when(F.col("__ts").isNull(), "null_date")
               .when(F.col("__client") == "", "empty_client")
               .when(F.col("__sku") == "", "empty_sku")
               .when(F.col("__price") <= 0, "price_not_positive")
               .when(F.col("__qty") <= 0, "quantity_not_positive"))
    return out.withColumn("reject_reason", reason)


def clean_feed(df: DataFrame, keep: Sequence[str] = ("tenant_id",), salt: str | None = None,
               **cols) -> DataFrame:
    """Valid records as (keep..., client_hash, product_code, quantity, price,
    order_date, transaction_date)."""
    return clean_classified(classify_feed(df, **cols), keep, salt)


def clean_classified(c: DataFrame, keep: Sequence[str] = ("tenant_id",), salt: str | None = None,
                     all_rows: bool = False) -> DataFrame:
    """The clean records of a feed that ``classify_feed`` has already read; with ``all_rows``
    every record in clean form, with its reject reason."""
    keep = list(dict.fromkeys(k for k in keep if k in c.columns and k not in CLEAN_COLUMNS))
    if all_rows:
        keep.append("reject_reason")
    return ((c if all_rows else c.filter(F.col("reject_reason").isNull()))
             .select(*keep,
                     _sha(F.col("__client"), salt).alias("client_hash"),
                     F.col("__sku").alias("product_code"),
                     F.col("__qty").alias("quantity"),
                     F.col("__price").alias("price"),
                     order_date_text(F.col("__ts")).alias("order_date"),
                     F.col("__ts").alias("transaction_date")))


def _sha(stripped, salt):
    """SHA-256 of an already stripped client id (``hash_client`` without a second strip)."""
    return F.sha2(F.concat(F.lit(salt), stripped) if salt else stripped, 256)


def rejected_feed(df: DataFrame, **cols) -> DataFrame:
    """The rows the cleaner drops, with the first failing rule."""
    c = classify_feed(df, **cols)
    return c.filter(F.col("reject_reason").isNotNull()).drop(
        "__client", "__sku", "__qty", "__price", "__ts")


def ingest_stats(df: DataFrame, keys: Sequence[str] = ("tenant_id",), **cols) -> DataFrame:
    """Processed / sent / filtered counters in one aggregation."""
    return classified_stats(classify_feed(df, **cols), keys)


def classified_stats(c: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    ok = F.col("reject_reason").isNull()
    return (c.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("processed"),
                  F.count_if(ok).alias("sent"),
                  F.count_if(~ok).alias("filtered")))


def source_count(df: DataFrame) -> DataFrame:
    """A2: row count of a source as a one-row frame (``rows == 0`` means stop)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def capped(df: DataFrame, n: int, order_cols: Sequence) -> DataFrame:
    """The first ``n`` rows in a fixed order (top-k, so only n rows move)."""
    return df.orderBy(*order_cols).limit(n)


def mark_cap(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """A3 / B10 without losing rows: every row, with ``within_cap`` true for the first ``n`` in
    ascending order (nulls first; rows equal to the n-th one count as well).  The rows are
    computed once, as the selection reads them several times."""
    df = staged(df, "capped-rows")
    cut = nth_key(df, n, order_cols)
    return df.withColumn("within_cap", F.lit(False) if cut is None else F.struct(*order_cols) <= cut)


def nth_key(df: DataFrame, n: int, order_cols: Sequence[str], pivots: int = 32, few: int = 4096) -> Column | None:
    """The key of the n-th row in ascending order (of the last one where there are fewer rows), as a
    constant; None without rows.

    Selection by counting: a few random keys cut the range that holds the n-th key, one partial
    aggregation counts the rows of each piece, and the piece with the n-th row is the next range,
    until it has one key or at most ``few`` rows.  A key that was drawn is a piece of its own, so
    one that is repeated without end is found as soon as it is drawn.  Every pass leaves about one row of
    ``pivots``; no task holds more than ``few`` keys, whatever ``n`` is."""
    types = dict(df.select(*order_cols).dtypes)
    key = F.struct(*[F.col(c) for c in order_cols])

    def constant(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order_cols])

    # the leading column alone is a condition that a scan can use
    first = F.col(order_cols[0])
    rows, rest, size = df, n, None
    while n > 0:
        if size is not None and size <= few:
            last = rows.select(key.alias("k")).orderBy("k").limit(rest).agg(F.max("k").alias("k")).first()["k"]
            return constant(last)
        drawn = sorted_rows(rows.select(key.alias("k")).orderBy(F.rand(len(order_cols))).limit(pivots).distinct())
        if not drawn:
            return None
        at = F.array(*[constant(r) for r in drawn])
        # pieces: 2 i below the i-th pivot, 2 i + 1 the pivot itself
        piece = (2 * F.size(F.filter(at, lambda p: p < F.col("k"))) + F.array_contains(at, F.col("k")).cast("int"))
        counts = {r["piece"]: r for r in rows.select(key.alias("k")).groupBy(piece.alias("piece")).agg(
            F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
        if size is None:
            rest = min(rest, sum(r["n"] for r in counts.values()))
        for i in sorted(counts):
            if counts[i]["n"] >= rest:
                break
            rest -= counts[i]["n"]
        lo, hi, size = counts[i]["lo"], counts[i]["hi"], counts[i]["n"]
        if i % 2 or lo == hi:
            return constant(lo)
        rows = df.filter((key >= constant(lo)) & (key <= constant(hi)))
        if lo[0] is not None:
            rows = rows.filter((first >= F.lit(lo[0]).cast(types[order_cols[0]])) & (first <= F.lit(hi[0]).cast(types[order_cols[0]])))
    return None


def sorted_rows(keys: DataFrame) -> list:
    """A bounded frame of keys ``k``, sorted as Spark sorts them."""
    return [r["k"] for r in keys.orderBy("k").collect()]


def delta(df: DataFrame, marker: str | None, ts_col: str = "transaction_date", overlap: str | None = None) -> DataFrame:
    """Rows strictly after the normalised marker; no marker means no filter.

    With ``overlap`` (an interval such as ``7 days``) also the rows of that time before it, which
    ``unseen`` compares with what is stored."""
    return df.filter(F.col(ts_col).cast("timestamp_ntz") > since(marker, overlap)) if marker else df


def since(marker: str, overlap: str | None = None) -> Column:
    """The time that a delta load reads from."""
    at = marker_timestamp(F.lit(marker))
    return at - F.expr(f"INTERVAL {overlap}") if overlap else at


def unseen(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that ``stored`` does not hold yet, as multisets: a row that comes n times and is stored
    m times stays n - m times.  ``key`` decides what is equal, nulls included; the other columns
    must follow from it.  Both sides are counted in one aggregation, map-side first, so a row that
    is repeated very often is one row a task."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    come = rows.select(*key, rest.alias("__rest"), F.lit(1).cast("bigint").alias("__left"))
    have = stored.select(*key, F.lit(None).alias("__rest"), F.lit(-1).cast("bigint").alias("__left"))
    counted = come.unionByName(have).groupBy(*key).agg(
        F.sum("__left").alias("__left"), F.first("__rest", ignorenulls=True).alias("__rest"))
    return (counted.filter("__left > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__left"))))
            .select(*[c if c in key else F.col(f"__rest.{c}").alias(c) for c in rows.columns]))


def union_feeds(dfs: Iterable[DataFrame]) -> DataFrame:
    """Concatenate feeds by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def coerce_workbook(df: DataFrame) -> DataFrame:
    """Drop rows without a customer, id float->int->text, sku to text,
    non-numeric price/quantity -> 0, quantity truncated to int."""
    cid = F.col("Customer ID").cast("double").cast("long").cast("string")
    price = F.coalesce(F.col("Price").cast("string").try_cast("double"), F.lit(0.0))
    q = F.col("Quantity").cast("string").try_cast("double")
    qty = F.coalesce(F.when(~F.isnan(q), q).try_cast("long").try_cast("int"), F.lit(0))
    return (df.filter(F.col("Customer ID").isNotNull() & ~F.isnan(F.col("Customer ID")))
              .withColumn("Customer ID", cid)
              .withColumn("StockCode", F.col("StockCode").cast("string"))
              .withColumn("Price", price)
              .withColumn("Quantity", qty))


def for_tenant(df: DataFrame, tenant_id: int | None) -> DataFrame:
    """Tenant scope; a filter on the partition column prunes files."""
    return df if tenant_id is None else df.filter(F.col("tenant_id") == F.lit(tenant_id))


def tenants_with_min(df: DataFrame, keys: Sequence[str], n: int = 10,
                     count_distinct: str | None = None) -> DataFrame:
    """Keep groups with at least ``n`` rows (or distinct values of a column)."""
    agg = F.count(F.lit(1)) if count_distinct is None else F.count_distinct(count_distinct)
    ok = df.groupBy(*keys).agg(agg.alias("__n")).filter(F.col("__n") >= n).select(*keys)
    return df.join(ok, list(keys), "left_semi")


def batch_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct keys of a batch."""
    return df.select(*cols).distinct()
