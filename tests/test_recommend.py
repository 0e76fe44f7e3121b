"""Semantic roles, aggregation rules and recommendation steps on literal
column profiles."""

from pyspark.sql import functions as F

from tabulon.plans.recommend import catalog as CT
from tabulon.plans.recommend import semantics as S

HR = [("Employee_ID", "numeric", 1.0, 500, "high"), ("First_Name", "text", 0.9, 450, "high"),
      ("Department", "categorical", 0.01, 6, "low"), ("Age", "numeric", 0.1, 40, "medium"),
      ("Monthly_Salary", "numeric", 0.9, 450, "high"), ("Performance_Rating", "numeric", 0.01, 5, "low"),
      ("Joining_Date", "date", 0.9, 450, "high"), ("Attendance_Percent", "numeric", 0.2, 90, "high"),
      ("Status", "categorical", 0.004, 2, "binary")]


def _profile(spark, cols, ds="hr"):
    rows = [(ds, i, c, t, 0.0, u, n, k, 0.0) for i, (c, t, u, n, k) in enumerate(cols)]
    return spark.createDataFrame(rows, "dataset_id string, ordinal int, column string, type string, "
                                       "null_ratio double, unique_ratio double, cardinality_count long, "
                                       "cardinality_class string, missing_pct double")


def test_hr_roles(spark):
    sem = S.classify(_profile(spark, HR))
    roles = {r["column"]: r["semantic_role"] for r in sem.collect()}
    assert roles == {"Employee_ID": S.IDENTIFIER, "First_Name": S.SENSITIVE, "Department": S.CATEGORICAL,
                     "Age": S.DEMOGRAPHIC, "Monthly_Salary": S.MONETARY, "Performance_Rating": S.ORDINAL,
                     "Joining_Date": S.TEMPORAL, "Attendance_Percent": S.PERCENTAGE, "Status": S.STATUS}


def test_role_names(spark):
    names = [("order_id", "numeric"), ("email", "text"), ("signup_date", "text"), ("revenue", "numeric"),
             ("discount_rate", "numeric"), ("units", "numeric"), ("units_sold", "numeric"), ("city", "categorical"),
             ("sentiment", "text"), ("price_index", "numeric")]
    sem = S.classify(_profile(spark, [(n, t, 0.5, 10, "low") for n, t in names]))
    roles = {r["column"]: r["semantic_role"] for r in sem.collect()}
    assert roles["order_id"] == S.IDENTIFIER and roles["email"] == S.CONTACT
    assert roles["signup_date"] == S.TEMPORAL and roles["revenue"] == S.MONETARY
    assert roles["discount_rate"] == S.PERCENTAGE and roles["units"] == S.ADDITIVE
    assert roles["units_sold"] == S.ORDINAL   # no additive pattern; low cardinality -> ordinal
    assert roles["city"] == S.GEOGRAPHIC and roles["sentiment"] == S.TEMPORAL   # 'time' inside 'sentiment'
    assert roles["price_index"] == S.MONETARY


def test_aggregation_validation(spark):
    specs = spark.createDataFrame([(S.PERCENTAGE, "sum"), (S.PERCENTAGE, "Average"), (S.IDENTIFIER, "distinct"),
                                   (S.CONTACT, "count"), (S.MONETARY, "none"), ("made_up", "sum"),
                                   (S.TEXT, "median"), (S.TEMPORAL, "median")],
                                  "semantic_role string, aggregation string")
    out = S.validate_aggregation(specs, S.aggregation_rules(spark)).collect()
    got = [(r["valid"], r["suggested"]) for r in out]
    assert got == [(False, "avg"), (True, None), (True, None), (False, None), (True, None), (False, "count"),
                   (False, "count"), (False, "trend")]


def test_pipeline_limits(spark):
    kpis, charts = CT.recommend(_profile(spark, HR))
    k = kpis.collect()
    assert 0 < len(k) <= 6 and all(r["semantic_role"] != S.SENSITIVE for r in k)
    c = charts.collect()
    assert 0 < len(c) <= 6 and sum(r["priority"] != "primary" for r in c) <= 3


def test_routing_and_questions(spark):
    prof = spark.createDataFrame(
        [("ds", 0, "region", "string", "string"), ("ds", 1, "sales", "number", "number"),
         ("ds", 2, "day", "date", "date")], "dataset_id string, ordinal int, column string, kind string, "
                                            "strict_type string")
    qs = spark.createDataFrame([("ds", "1", "Show sales trend over time"), ("ds", "2", "top 3 region by sales"),
                                ("ds", "3", "average sales per region")], "dataset_id string, question_id string, "
                                                                          "question string")
    out = {r["question_id"]: r for r in CT.route_questions(qs, prof).collect()}
    assert out["1"]["action"] == "compare_periods" and out["1"]["date_column"] == "day"
    assert out["2"]["action"] == "top_n" and out["2"]["limit"] == 3 and out["2"]["direction"] == "desc"
    assert out["3"]["action"] == "group_by" and out["3"]["aggregation"] == "avg"
    q = [r["question"] for r in CT.suggested_questions(prof).orderBy("position").collect()]
    assert q == ["Which region performs best?", "Show sales by day.", "Why did sales drop?",
                 "What are the top 5 region?"]


def test_rewrite_quantity_by_order(spark):
    prof = spark.createDataFrame([("ds", 0, "order_id"), ("ds", 1, "customer_id"), ("ds", 2, "quantity")],
                                 "dataset_id string, ordinal int, column string")
    specs = spark.createDataFrame([("ds", "order_id", "quantity", "avg")],
                                  "dataset_id string, x_field string, y_field string, aggregation string")
    r = CT.rewrite_specs(specs, prof).first()
    assert r["x_field"] == "customer_id" and r["custom_title"] == "Average quantity per customer"
    assert F is not None
