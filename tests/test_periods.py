"""Period bounds, comparison, KPI cards and granularity."""

import datetime as dt

from pyspark.sql import functions as F

from tabulon.operators import periods as PD
from tabulon.operators import series as SR


def _cmp(spark, cur, pri, cn, pn, has=True):
    df = spark.range(1)
    c = PD.compare(F.lit(cur).cast("double"), F.lit(pri).cast("double"), F.lit(cn), F.lit(pn), F.lit(has))
    r = df.select(c.alias("c")).first()["c"]
    return r["delta_pct"], r["delta_direction"], r["period"]


def test_compare(spark):
    assert _cmp(spark, 150, 100, 1, 1) == (50.0, "up", "vs prior period")
    assert _cmp(spark, 80, 100, 1, 1) == (-20.0, "down", "vs prior period")
    assert _cmp(spark, 100, 100, 1, 1) == (0.0, "flat", "vs prior period")
    assert _cmp(spark, 0, 100, 0, 1) == (None, "flat", "No data for this period")
    assert _cmp(spark, 10, 0, 1, 0) == (None, "flat", "No prior period data for comparison")
    assert _cmp(spark, 10, 0, 1, 1) == (100.0, "up", "vs prior period")
    assert _cmp(spark, 10, 5, 1, 1, has=False) == (None, "flat", None)


def test_kpi_cards_no_current_data(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 1), 100.0, 50.0), (dt.datetime(2026, 7, 3), 200.0, None)],
                               "Date timestamp_ntz, Revenue double, Expenses double")
    cards = {r["kpi"]: r for r in PD.kpi_cards(df, [PD.KpiSpec("revenue", "Revenue", "sum"),
                                                    PD.KpiSpec("expenses", "Expenses", "sum")],
                                               date_col="Date").collect()}
    assert cards["revenue"]["value"] == 200.0 and cards["revenue"]["delta_direction"] == "up"
    assert cards["expenses"]["period"] == "No data for this period"
    g = PD.growth_card(PD.kpi_cards(df, [PD.KpiSpec("revenue", "Revenue", "sum")], date_col="Date")).first()
    assert g["label"] == "Revenue Growth %" and g["value"] == 100.0


def test_distinct_kpi(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, d), f"c{d % 3}") for d in range(1, 29)] + [(None, None)],
                               "d timestamp_ntz, cust string")
    r = PD.kpi_cards(df, [PD.KpiSpec("customers", "cust", "distinct")], date_col="d").first()
    assert r["value"] == 3.0 and r["current_count"] == 3


def _gran(spark, days):
    lo = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(lo,), (lo + dt.timedelta(days=days),)] if days is not None else [(None,)],
                               "d timestamp_ntz")
    return df.select(SR.granularity_scalar(df, "d").alias("g")).first()["g"]


def test_granularity(spark):
    assert _gran(spark, 19) == "day"
    assert _gran(spark, 90) == "week"
    assert _gran(spark, 540) == "month"
    assert _gran(spark, 1096) == "quarter"
    assert _gran(spark, 2400) == "year"
    assert _gran(spark, None) == "month"


def test_bucket_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3),)], "d timestamp_ntz")
    r = df.select(*[SR.bucket_label(F.col("d"), g).alias(g) for g in ("day", "week", "month", "quarter", "year")]).first()
    assert tuple(r) == ("2021-01-03", "2020-W53", "2021-01", "2021-Q1", "2021")


def test_relative_filter(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 20, 25, 31)], "d timestamp_ntz")
    assert PD.relative_date_filter(df, "d", "7days").count() == 2
    assert PD.relative_date_filter(df, "d", "all").count() == 4
