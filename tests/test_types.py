"""Type detection on literal rows (metadata and upload rules)."""

from tabulon.operators import profile as PF


def _profile(spark, values, name="col"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    return PF.profile(df, with_samples=False).first()


def test_mixed_dates_above_threshold(spark):
    vals = ["2023-01-01", "02/15/2023", "31-12-2023", "2023-06-15", "2023.08.20", "2023/11/05", "12-25-2023",
            "01/01/2024", "2024-02-29", "10 May 2024", "not-a-date"]
    assert _profile(spark, vals, "dateCol")["metadata_type"] == "date"


def test_mixed_dates_below_threshold(spark):
    vals = ["2023-01-01", "02/15/2023", "31-12-2023", "2023-06-15", "2023.08.20", "2023/11/05", "12-25-2023",
            "01/01/2024", "2024-02-29", "invalid-1", "invalid-2"]
    assert _profile(spark, vals, "dateCol")["metadata_type"] == "text"


def test_booleans(spark):
    vals = ["Yes", "No", "yes", "NO", "true", "false", "true", "false", "1", "0", None]
    assert _profile(spark, vals, "boolCol")["metadata_type"] == "boolean"
    assert _profile(spark, ["Yes", "No", "Maybe"], "boolCol")["metadata_type"] == "text"


def test_currency_by_name_and_symbol(spark):
    assert _profile(spark, ["100", "200", None, "300"], "price")["metadata_type"] == "currency"
    assert _profile(spark, ["$100.50", "€200", "£300.99", "¥4,000"], "myCol")["metadata_type"] == "currency"


def test_percentage_by_name_range_and_suffix(spark):
    assert _profile(spark, ["0.5", "75.3", "100"], "conversion_rate")["metadata_type"] == "percentage"
    assert _profile(spark, ["105", "50", "-5"], "conversion_rate")["metadata_type"] == "numeric"
    assert _profile(spark, ["50%", "12.5 %", "100%"], "myCol")["metadata_type"] == "percentage"


def test_numeric_with_grouping(spark):
    assert _profile(spark, ["1,234", "56.78", "-12"], "numCol")["metadata_type"] == "numeric"


def test_upload_types(spark):
    r = _profile(spark, ["a@b.co", "c@d.org", "e@f.net", "g@h.io", "x"], "mail")
    assert (r["type"], r["detected_type"]) == ("text", "Email")
    r = _profile(spark, ["$5", "$1,200", "€3", "7 £", "$9"], "p")
    assert (r["type"], r["detected_type"]) == ("numeric", "Currency")
    r = _profile(spark, ["1", "2", "3", "4", "5"], "n")
    assert (r["type"], r["detected_type"]) == ("numeric", "Number")
    r = _profile(spark, ["2025-06-15", "2025-06-16", "2025-07-01"], "d")
    assert (r["type"], r["detected_type"]) == ("date", "Date")   # date before phone (deviation)


def test_upload_types_reference_order(spark):
    df = spark.createDataFrame([("2025-06-15",), ("2025-06-16",)], "d string")
    r = PF.profile(df, compat_order=True, with_samples=False).first()
    assert r["detected_type"] == "Phone Number"


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, ""), ("", None)], "col1 string, col2 string")
    out = {r["column"]: r for r in PF.profile(df, with_samples=False).collect()}
    assert out["col1"]["type"] == "text" and out["col1"]["null_ratio"] == 1.0
    assert out["col1"]["missing"] == 2 and out["col2"]["cardinality_class"] == "binary"


def test_cardinality_and_ratios(spark):
    vals = ["A", "a ", "B", "C", None]
    r = _profile(spark, vals, "cat")
    assert r["distinct_ci"] == 3 and r["null_ratio"] == 0.2 and r["unique_ratio"] == 0.75
    assert r["type"] == "categorical"


def test_typed_columns_count_as_their_text_does(spark):
    """The counts by type equal those of the text rules over the same values."""
    import datetime as dt
    from decimal import Decimal
    rows = [(1, 0, 10 ** 12, 1.0, 0.5, Decimal("7"), Decimal("12.50"), dt.datetime(2024, 2, 29, 1, 2, 3, 4), dt.date(1999, 1, 1), True),
            (-100000, 1, -5, 1e300, 100.0, Decimal(10 ** 21), Decimal("0.00"), dt.datetime(1500, 1, 1), dt.date(2100, 12, 31), False),
            (1000000, None, 99, float("nan"), -2.0, Decimal(-123456), None, dt.datetime(9999, 1, 1), None, None),
            (999999, 5, 2 ** 62, float("inf"), 0.1, None, Decimal("101.01"), None, dt.date(2000, 1, 1), True)]
    df = spark.createDataFrame(rows, "i int, b byte, l long, d double, f float, n decimal(30,0), m decimal(10,2), t timestamp_ntz, dd date, x boolean")
    cols = df.columns
    key = lambda r: {k: v for k, v in r.asDict().items() if k not in ("len_sum",)}
    typed = {r["column"]: key(r) for r in PF.typed_stats(df, cols, {c: i for i, c in enumerate(cols)}).collect()}
    text = {r["column"]: key(r) for r in PF.column_stats(PF.long_values(df, cols), False).collect()}
    assert typed == text
