import math
import uuid

from pyspark.sql import functions as F

from shopsight.functions import scalar as S


def test_uuid5_matches_python(spark):
    names = ["tenant_6_abc_2020-01-01", "tenant_1_Ωé клієнт_2020-01-01 00:00:00", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.u for r in df.select("n", S.uuid5_dns(F.col("n")).alias("u")).collect()}
    for n in names:
        assert got[n] == str(uuid.uuid5(uuid.NAMESPACE_DNS, n))
    assert got["tenant_6_abc_2020-01-01"] == "d4df32fa-3128-5ba3-a60c-539419abd346"


def test_order_id_and_number(spark):
    df = spark.createDataFrame([(6, "abc", "2020-01-01")], "t int, h string, d string")
    r = df.select(S.order_id("t", "h", "d").alias("id")).select(
        "id", S.order_number("id").alias("no")).first()
    assert r.id == "d4df32fa-3128-5ba3-a60c-539419abd346"
    assert r.no == "ORD-D4DF32FA"


def test_hash_client_strips_like_python(spark):
    import hashlib
    df = spark.createDataFrame([(" \tClient 7 \n",)], "c string")
    assert df.select(S.hash_client("c")).first()[0] == hashlib.sha256(b"Client 7").hexdigest()


def test_compact_currency(spark):
    vals = [None, float("nan"), 0.0, 999.994, 1000.0, 15320.0, 999999.0, 1234567.0, 2500000.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(S.compact_currency("v")).collect()]
    assert got == ["0.00", "0.00", "0.00", "999.99", "1.0K", "15.3K", "1000.0K", "1.23M", "2.50M"]


def test_percent_and_labels(spark):
    df = spark.createDataFrame([(0.01234, 0.4567, ["A", "B"], ["C"])],
                               "s double, c double, a array<string>, b array<string>")
    r = df.select(S.percent("s", 2).alias("s"), S.percent("c", 1).alias("c"),
                  S.rule_label("a", "b").alias("l")).first()
    assert (r.s, r.c, r.l) == ("1.23%", "45.7%", "A, B -> C")
    # an item holding the arrow breaks the split, as in the reference
    df2 = spark.createDataFrame([("x -> y -> z",)], "l string")
    r2 = df2.select(S.label_side("l", 0), S.label_side("l", 1)).first()
    assert tuple(r2) == ("x", "y")


def test_marker_normalisation(spark):
    df = spark.createDataFrame([("1998-01-01T10:11:12.123456+00:00",)], "m string")
    assert df.select(S.normalize_marker("m")).first()[0] == "1998-01-01 10:11:12"


def test_clean_advice(spark):
    df = spark.createDataFrame([("  **Порада** один.\n* Два • три.  ",)], "t string")
    assert df.select(S.clean_advice("t")).first()[0] == "Порада один.  Два  три."
    assert not math.isnan(0.0)


def test_marker_offsets_are_applied(spark):
    from shopsight.sources.jdbc import normalize_marker_text
    cases = {"2024-05-01T10:11:12.999+00:00": "2024-05-01 10:11:12", "2024-05-01T10:11:12+02:00": "2024-05-01 08:11:12",
             "2024-05-01T00:30:00-05:30": "2024-05-01 06:00:00", "2024-05-01T10:11:12Z": "2024-05-01 10:11:12",
             "2024-05-01 10:11:12.5": "2024-05-01 10:11:12"}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r.m: r.t for r in df.select("m", S.normalize_marker("m").alias("t")).collect()} == cases
    assert {k: normalize_marker_text(k) for k in cases} == cases


def test_prompt_texts():
    from shopsight.operators import advice
    assert "Одне речення описує одну пораду. \n    2. " in advice.SEGMENT_PROMPT
    assert "    Дані аналізу: \n    Користувачі" in advice.BUNDLE_PROMPT
