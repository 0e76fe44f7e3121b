"""Business roles (R3), domain classification (R5), insights and number
display (G7, G8) on literal rows."""

from pyspark.sql import functions as F

from tabulon.plans import insights as IN
from tabulon.plans.recommend import domain as D
from tabulon.plans.recommend import semantics as S


def test_business_roles(spark):
    rows = [("ds", 0, "order_id", "numeric", 100, 100, 100, 0, 0, 0, 300),
            ("ds", 1, "email", "text", 100, 100, 100, 95, 0, 0, 1500),
            ("ds", 2, "signup_date", "date", 100, 90, 100, 0, 0, 0, 1000),
            ("ds", 3, "revenue", "numeric", 100, 80, 100, 0, 0, 0, 500),
            ("ds", 4, "score", "numeric", 100, 5, 100, 0, 0, 0, 100),
            ("ds", 5, "status", "text", 100, 3, 100, 0, 0, 0, 600),
            ("ds", 6, "comments", "text", 100, 97, 100, 0, 0, 0, 9000),
            ("ds", 7, "city", "text", 100, 60, 100, 0, 0, 0, 700)]
    prof = spark.createDataFrame(rows, "dataset_id string, ordinal int, column string, metadata_type string, "
                                       "rows long, distinct_raw long, non_empty long, n_email long, n_phone long, "
                                       "n_url long, len_sum long")
    got = {r["column"]: (r["business_role"], r["needs_review"]) for r in S.business_roles(prof).collect()}
    assert got == {"order_id": ("identifier", False), "email": ("ignore", False),
                   "signup_date": ("dimension", False), "revenue": ("metric", False),
                   "score": ("metric", True), "status": ("dimension", False),
                   "comments": ("ignore", True), "city": ("ignore", False)}


def test_domain_classification(spark):
    cols = spark.createDataFrame([("hr", c) for c in ("employee_id", "department", "salary", "attendance")] +
                                 [("misc", "zzz")], "dataset_id string, column string")
    ds = spark.createDataFrame([("hr", "staff.csv"), ("misc", "x.csv")], "dataset_id string, file_name string")
    got = {r["dataset_id"]: (r["domain"], r["confidence"]) for r in D.classify_domains(cols, ds).collect()}
    assert got["hr"][0] == "hr" and 0.45 <= got["hr"][1] <= 0.97
    assert got["misc"] == ("general", 0.4)


def test_number_display(spark):
    df = spark.createDataFrame([(1234.0,), (2_500_000.0,), (7.0e9,), (-1500.0,), (None,)], "v double")
    got = [r[0] for r in df.select(IN.format_value("v", "currency")).collect()]
    assert got == ["₹1.2K", "₹2.5M", "₹7B", "₹-1.5K", "—"]
    got = [r[0] for r in df.select(IN.format_kpi(F.col("v"), "percent")).limit(2).collect()]
    assert got == ["1,234%", "2,500,000%"]


def test_kpi_insights(spark):
    cards = spark.createDataFrame([("revenue", 1500.5, "currency")], "kpi string, value double, format string")
    growth = spark.createDataFrame([(-12.5,)], "value double")
    alerts = spark.createDataFrame([], "rule_id string, label string, triggered_count long, severity string")
    got = {r["id"]: r["text"] for r in IN.kpi_insights(cards, growth, alerts).collect()}
    assert got == {"ins-growth": "Overall growth trend is -12.5% compared to the prior period.",
                   "ins-revenue": "Total revenue is ₹1,500.5 across the active period.",
                   "ins-clean": "All baseline validation checks passed. Data trends look stable."}
