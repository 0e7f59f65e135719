"""Column expressions built only from Spark built-ins (no Python UDFs).

Every function takes and returns ``Column`` objects so the work stays inside
whole-stage code generation.  Repeated sub-expressions (the order-id digest)
are computed once per row by Spark's subexpression elimination.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results.
# RFC 4122 namespace for DNS names (the uuid5 namespace of order ids).
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"
# Text format of an order date inside the order-id name.
ORDER_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Prefix of the human order number.
ORDER_NUMBER_PREFIX = "ORD-"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- B2 / B5: text clean-up and pseudonymisation -----------------------------

def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace.

    Spark's ``trim`` only removes spaces, so tabs and other blanks need a regex.
    """
    return F.regexp_replace(_c(col).cast("string"), r"(?U)^\s+|\s+$", "")


def hash_client(col, salt: str | None = None) -> Column:
    """SHA-256 hex of the stripped client id; an optional salt is prepended."""
    text = strip_ws(col)
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.sha2(text, 256)


# --- B8 / B13: dates and sync markers ------------------------------------------

def order_date_text(ts) -> Column:
    """Render a timestamp the way it enters the order id (``yyyy-MM-dd HH:mm:ss``)."""
    return F.date_format(_c(ts), ORDER_DATE_FORMAT)


def normalize_marker(col) -> Column:
    """ISO marker text -> ``yyyy-MM-dd HH:mm:ss``: an offset is applied (UTC), then the
    fraction is cut off."""
    text = strip_ws(col)
    plain = F.substring(F.regexp_replace(text, "T", " "), 1, 19)
    moved = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()), ORDER_DATE_FORMAT)
    return F.when(text.rlike(r"\d(?:Z|[+-]\d{2}(?::?\d{2})?)$") & F.contains(text, F.lit(":")), moved).otherwise(plain)


def marker_timestamp(col) -> Column:
    return F.to_timestamp_ntz(normalize_marker(col), F.lit(ORDER_DATE_FORMAT))


# --- C4 / C5: deterministic order identity -------------------------------------

def uuid5_digest(name) -> Column:
    """SHA-1 of (DNS namespace bytes || UTF-8 name), as 40 hex digits."""
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS_HEX)), F.encode(_c(name), "UTF-8")))


def uuid_from_digest(d) -> Column:
    """Canonical UUID v5 text from a SHA-1 hex digest: version nibble 5, variant 10xx.

    Reference the digest through a column so it is computed once per row.
    """
    d = _c(d)
    variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"),
                    F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3),
                    F.lit("-"), F.substring(d, 21, 12))


def uuid5_dns(name) -> Column:
    """UUID version 5 (DNS namespace) of a string column (digest bound once in a lambda)."""
    return F.transform(F.array(uuid5_digest(name)), uuid_from_digest)[0]


def order_id_name(tenant_id, client_hash, order_date) -> Column:
    return F.concat(F.lit("tenant_"), _c(tenant_id).cast("string"), F.lit("_"),
                    _c(client_hash), F.lit("_"), _c(order_date))


def order_id(tenant_id, client_hash, order_date) -> Column:
    """Order (basket) id: one client at one exact date string within a tenant."""
    return uuid5_dns(order_id_name(tenant_id, client_hash, order_date))


def order_number(order_id_col) -> Column:
    return F.concat(F.lit(ORDER_NUMBER_PREFIX), F.upper(F.substring(_c(order_id_col), 1, 8)))


# --- F1 / F4 / F5: display formatting -------------------------------------------

def fixed(col, decimals: int) -> Column:
    """Round half-up and render with exactly ``decimals`` digits (like ``toFixed``)."""
    return F.round(_c(col), decimals).cast(f"decimal(38,{decimals})").cast("string")


def compact_currency(col) -> Column:
    """``>=1e6`` -> ``x.xxM``, ``>=1e3`` -> ``x.xK``, else 2 decimals; NULL/NaN -> ``0.00``."""
    v = _c(col).cast("double")
    return (F.when(v.isNull() | F.isnan(v), F.lit("0.00"))
            .when(v >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit("M")))
            .when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K")))
            .otherwise(fixed(v, 2)))


def percent(col, decimals: int) -> Column:
    """A share in [0, 1] shown as a percentage with ``decimals`` digits."""
    return F.concat(fixed(_c(col) * 100, decimals), F.lit("%"))


# --- F2 / F3: rule labels --------------------------------------------------------

RULE_ARROW = " -> "
ITEM_SEP = ", "


def rule_label(antecedent, consequent) -> Column:
    return F.concat(F.array_join(_c(antecedent), ITEM_SEP), F.lit(RULE_ARROW),
                    F.array_join(_c(consequent), ITEM_SEP))


def label_side(label, side: int) -> Column:
    """Part ``side`` (0 or 1) of a label split on the arrow (breaks if an item holds it)."""
    return F.element_at(F.split(_c(label), RULE_ARROW, -1), side + 1)


# --- F6: cluster / segment labels --------------------------------------------------

def cluster_name(cid) -> Column:
    return F.format_string("Cluster %d", _c(cid))


def cluster_name_ua(cid) -> Column:
    return F.format_string("Кластер %d", _c(cid))


def segment_legend(cid, count) -> Column:
    return F.format_string("Сегмент %d (%d чол)", _c(cid), _c(count))


# --- F7: model text clean-up --------------------------------------------------------

def clean_advice(col) -> Column:
    """Strip, drop ``**``, ``*`` and ``•``, newlines to spaces, strip again."""
    t = strip_ws(col)
    t = F.regexp_replace(t, r"\*\*", "")
    t = F.regexp_replace(t, r"\*", "")
    t = F.regexp_replace(t, "•", "")
    t = F.regexp_replace(t, "\n", " ")
    return strip_ws(t)
