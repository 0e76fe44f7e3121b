"""Top-k with 'Other', histogram, filter options, downsampling, analysis ops."""

from pyspark.sql import functions as F

from tabulon.operators import analysis as AN
from tabulon.operators import series as SR
from tabulon.operators import stats as ST


def test_top_with_other(spark):
    df = spark.range(150).select(F.col("id").cast("string").alias("k"), (F.col("id") + 1).cast("double").alias("v"))
    out = SR.top_with_other(df, "k", "v", "sum").collect()
    assert len(out) == 100
    other = [r for r in out if r["x"] == "Other"][0]
    assert other["y"] == float(sum(range(1, 52)))
    df100 = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1.0).alias("v"))
    assert all(r["x"] != "Other" for r in SR.top_with_other(df100, "k", "v", "sum").collect())


def test_other_average_is_recombined(spark):
    # groups 100..2 are the top 99; the rest is group '1' (one row, 1.0) and
    # group '0' (two rows of 0.0): the true average is 1/3, not (1 + 0) / 2
    rows = [(str(i), float(i)) for i in range(101)] + [("0", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["x"]: r["y"] for r in SR.top_with_other(df, "k", "v", "avg").collect()}
    assert abs(out["Other"] - 1.0 / 3) < 1e-12


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10)], "v double")
    h = {r["bin"]: r["y"] for r in SR.histogram(df, "v").collect()}
    assert len(h) == 10 and h[9] == 1 and h[0] == 1 and sum(h.values()) == 4


def test_filter_options_limit(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    out = SR.filter_options(df, ["a", "b"], limit=25).groupBy("column").count().collect()
    assert {r["column"]: r["count"] for r in out} == {"a": 25, "b": 1}


def test_downsample(spark):
    s = spark.range(250).select(F.format_string("%04d", "id").alias("x"), F.col("id").cast("double").alias("y"))
    out = SR.downsample(s, "x", 100).collect()
    assert len(out) == 84 and all(int(r["x"]) % 3 == 0 for r in out)


def test_forecast_and_outliers(spark):
    s = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "x string, y double")
    f = [r["y"] for r in ST.forecast(s).orderBy("step").collect()]
    assert f == [40, 50, 60, 70, 80, 90, 100]
    s2 = spark.createDataFrame([(str(i), 10.0) for i in range(9)] + [("z", 100.0)], "x string, y double")
    assert [r["x"] for r in ST.zscore_outliers(s2).collect()] == ["z"]


def test_analysis_ops(spark):
    df = spark.createDataFrame([("o1", "c1", 2.0), ("o2", "c1", 4.0), ("o3", "c2", None), (None, "c3", 1.0)],
                               "order_id string, customer_id string, quantity double")
    g = {r["customer_id"]: r["quantity"] for r in AN.group_by(df, "customer_id", "quantity", "avg").collect()}
    assert g == {"c1": 3.0, "c2": 1.0, "c3": 1.0}   # a group without numbers yields its row count
    t = AN.top_n(df, "customer_id", "quantity", limit=1).collect()
    assert [(r["customer_id"], r["quantity"]) for r in t] == [("c1", 6.0)]
    f = AN.filter_and_aggregate(df, "customer_id", "C1", "quantity", "sum", "customer_id").collect()
    assert [(r["customer_id"], r["quantity"]) for r in f] == [("c1", 6.0)]
    assert AN.filter_and_aggregate(df, "customer_id", "zzz", "quantity").count() == 0
    assert AN.filter_and_aggregate(df, "customer_id", "zzz", "quantity", fallback_all=True).count() == 3
