"""The exported RFM documents are those of the production job."""

import csv
import glob
import io

from pyspark.sql import functions as F

from shopsight.operators import reports as rp
from shopsight.plans import q_jobs


def test_exported_documents_hold_the_whole_sweep(spark):
    doc = q_jobs.exported(spark, "/root/testdata/sf0.01")
    rows = doc.select(F.sort_array(F.map_keys("tuning_history")).alias("ks"),
                      F.expr("aggregate(map_values(segments), 0L, (s, x) -> s + x.customer_count)").alias("n")).collect()
    assert rows and all(r.ks == [str(k) for k in range(2, 10) if k <= r.n - 1] for r in rows)


def test_rule_csv_has_a_mark_and_quotes_item_lists_only(spark, tmp_dir):
    rules = spark.createDataFrame(
        [(1, ["a"], ["b", "c"], 0.5, 1.0, 1.25), (1, ['5" disc', "x,y"], [" z "], 0.1, 0.2, 0.3), (2, ["q"], ["#r"], 0.1, 0.2, 0.3)],
        "tenant_id int, antecedent array<string>, consequent array<string>, support double, confidence double, lift double")
    rp.export_rules_csv(rules.coalesce(1), f"{tmp_dir}/csv")
    for tenant, n in ((1, 2), (2, 1)):
        files = [open(f, "rb").read().decode("utf-8") for f in glob.glob(f"{tmp_dir}/csv/tenant_id={tenant}/*.csv")]
        assert all(t.startswith("\ufeffAntecedent,Consequent,Support,Confidence,Lift\n") for t in files)
        lines = sorted(x for t in files for x in t.split("\n")[1:] if x)
        assert len(lines) == n
        if tenant == 1:
            assert lines == ['"5"" disc, x,y"," z ",0.1000,0.2000,0.3000', '"a","b, c",0.5000,1.0000,1.2500']
            assert next(csv.reader(io.StringIO(lines[0])))[0] == '5" disc, x,y'
    back = spark.read.option("header", True).option("escape", '"').schema("A string, C string, S string").csv(f"{tmp_dir}/csv")
    assert sorted(r.A for r in back.collect()) == ['5" disc, x,y', "a", "q"]
