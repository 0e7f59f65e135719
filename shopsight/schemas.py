"""StructTypes of the warehouse, the wire record and the report payloads."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

SYNC_RECORD = T.StructType([
    T.StructField("client_hash", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", MONEY),
    T.StructField("order_date", T.StringType()),
])

TENANTS = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("tenant_key", T.StringType()),
    T.StructField("last_sync_date", T.TimestampNTZType()),
])

CUSTOMERS = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("customer_hash", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("price", MONEY),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("customer_hash", T.StringType()),
    T.StructField("transaction_date", T.TimestampNTZType()),
    T.StructField("order_number", T.StringType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", MONEY),
    T.StructField("customer_hash", T.StringType()),
    T.StructField("transaction_date", T.TimestampNTZType()),  # date key of the fact row
    T.StructField("batch_id", T.LongType()),
])

REPORTS = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("report_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SEGMENT = T.StructType([
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("recency", T.DoubleType()),
    T.StructField("frequency", T.DoubleType()),
    T.StructField("monetary", T.DoubleType()),
    T.StructField("customer_count", T.LongType()),
])

RULE = T.StructType([
    T.StructField("if_bought", T.ArrayType(T.StringType())),
    T.StructField("then_buy", T.ArrayType(T.StringType())),
    T.StructField("support", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("lift", T.DoubleType()),
])

RFM_PAYLOAD = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("performance", T.StructType([
        T.StructField("optimized_k", T.IntegerType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("silhouette_metric", T.StringType()),
        T.StructField("davies_bouldin", T.DoubleType()),
    ])),
    T.StructField("comparison", T.StructType([
        T.StructField(c, T.DoubleType()) for c in (
            "base_silhouette", "base_davies_bouldin", "weighted_silhouette", "weighted_davies_bouldin",
            "silhouette_diff", "davies_bouldin_diff")
    ])),
    T.StructField("tuning_history", T.MapType(T.StringType(), T.StructType([
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("db_index", T.DoubleType()),
    ]))),
    T.StructField("correlation", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("segments", T.MapType(T.StringType(), SEGMENT)),
    T.StructField("assignments", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("cid", T.IntegerType()),
    ]))),
])

BASKET_PAYLOAD = T.StructType([
    T.StructField("algorithm", T.StringType()),
    T.StructField("parameters", T.StructType([
        T.StructField("min_support", T.DoubleType()),
        T.StructField("min_threshold", T.DoubleType()),
    ])),
    T.StructField("summary", T.StructType([
        T.StructField("total_orders", T.LongType()),
        T.StructField("rules_found", T.LongType()),
    ])),
    T.StructField("association_rules", T.ArrayType(RULE)),
])

# Detail tables of the report store, and the counters of a delivered batch.
RULE_ROWS = ("report_id string, tenant_id int, if_bought array<string>, then_buy array<string>, support double, "
             "confidence double, lift double")
ASSIGNMENT_ROWS = "report_id string, tenant_id int, id string, cid int"
BATCHES = "batch_id long, processed long, sent long, filtered long, unknown_key long"
