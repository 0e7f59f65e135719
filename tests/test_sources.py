import os

from pyspark.sql import types as T

from shopsight.sources import jdbc
from shopsight.sources.files import read_feeds, wider


def test_source_query_per_dialect():
    q = "SELECT c, s, q, p, d AS transaction_date FROM sales;"
    assert jdbc.source_query(q, "pg") == q.rstrip(";")
    marker = "2024-05-01T10:11:12.999+00:00"
    assert jdbc.source_query(q, "pg", marker).endswith(
        "WHERE CAST(t.transaction_date AS TIMESTAMP) > '2024-05-01 10:11:12'")
    assert jdbc.source_query(q, "mysql", marker).endswith("WHERE t.transaction_date > '2024-05-01 10:11:12'")
    assert "CAST(t.transaction_date AS DATETIME)" in jdbc.source_query(q, "mssql", marker)
    assert jdbc.source_query(q, "pg", marker).startswith("SELECT * FROM (SELECT c, s")


def test_read_feeds_unions_by_name(spark, tmp_dir):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    pa, pb = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    a.write.parquet(pa)
    b.write.parquet(pb)
    rows = read_feeds(spark, [pa, pb]).orderBy("k").collect()
    assert [(r.k, r.a, r.b) for r in rows] == [(1, "x", None), (2, None, "y")]


def test_read_feeds_scans_alike_files_once(spark, tmp_dir):
    """Sixty files of three schemas: three scans; int, double and text versions of a column are text."""
    ends = {"int": "3", "double": "2.5", "string": "'x'"}
    paths = [os.path.join(tmp_dir, f"sheet{i}") for i in range(60)]
    for kind, value in ends.items():
        df = spark.sql(f"select 1 as k, cast({value} as {kind}) as price")
        for p in paths[list(ends).index(kind)::3]:
            df.coalesce(1).write.parquet(p)
    out = read_feeds(spark, paths)
    assert dict(out.dtypes) == {"k": "int", "price": "string"}
    assert out.groupBy("price").count().orderBy("price").collect() == [("2.5", 20), ("3", 20), ("x", 20)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    numbers = read_feeds(spark, [p for i, p in enumerate(paths) if i % 3 < 2])
    assert dict(numbers.dtypes)["price"] == "double" and numbers.selectExpr("sum(price)").first()[0] == 110.0


def test_read_feeds_keeps_partition_folders_apart(spark, tmp_dir):
    for name in ("p", "q"):
        spark.sql("select 1 as k, 'a' as day").write.partitionBy("day").parquet(os.path.join(tmp_dir, name))
    rows = read_feeds(spark, [os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "q")]).collect()
    assert [(r.k, r.day) for r in rows] == [(1, "a"), (1, "a")]


def test_wider_types():
    cents = T.DecimalType(10, 2)
    assert wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert wider(T.LongType(), T.FloatType()) == T.DoubleType()
    assert wider(cents, T.IntegerType()) == T.DecimalType(21, 2)
    assert wider(cents, T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    assert wider(cents, T.DoubleType()) == T.DoubleType()
    assert wider(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert wider(T.NullType(), cents) == cents and wider(cents, T.StringType()) == T.StringType()
