"""Duplicates, validation and summaries on literal rows."""

from tabulon.operators import profile as PF


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 3), (4, 5)], "a int, b int")
    r = PF.duplicate_rows(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicate_rows"]) == (5, 3, 2)


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 2, 4), (None, None, 5)], "colA int, colB int, colC int")
    got = {(r["column"], r["duplicate_of"]) for r in PF.duplicate_columns(df).collect()}
    assert got == {("colB", "colA")}


def test_validate_rows_and_cells(spark):
    df = spark.createDataFrame([(1, "10", "2024-01-02"), (2, "x", "2024-01-03"), (3, "5", "nope"),
                                (4, None, None)], "id int, amount string, day string")
    count, sample = PF.validate_rows(df, {"amount": "numeric", "day": "date"}, "id")
    assert count.first()["problem_count"] == 2
    assert [r["row_key"] for r in sample.collect()] == [2, 3]
    cells = PF.validate_cells(df, {"amount": "Number", "day": "Date"}, "id")
    got = sorted((r["row_key"], r["column"], r["type"]) for r in cells.collect())
    assert got == [(2, "amount", "Type Mismatch"), (3, "day", "Invalid Date"), (4, "amount", "Missing Value"),
                   (4, "day", "Missing Value")]


def test_quality_report(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    from pyspark.sql import functions as F
    r = PF.quality_report(df, F.lit(3)).first()
    assert r["cleanliness"] == "98%" and r["problem_count"] == 3


def test_duplicate_headers():
    assert PF.duplicate_headers(["Name", "name ", "Age"]) == ["name "]


def test_sanitize_headers():
    from tabulon.sources.io import sanitize_headers
    assert sanitize_headers([" Sales ($) ", "", "Sales ($)", "@@"]) == ["Sales ", "Sales _1", "column"]
