"""Jobs whose tasks and driver must not grow with the data: profiles, pages, dashboards."""

import datetime as dt

from pyspark.sql import functions as F

from tabulon.operators import dashboard as DB
from tabulon.operators import paging as PG
from tabulon.operators import profile as PF


def _odd(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0.0, "A", t, True), (1, -0.0, "a", t, None), (2, float("nan"), " a ", t + dt.timedelta(microseconds=1), False), (None, None, None, None, True),
            (3, float("nan"), "", t, True), (1, 1.5, "x" * 300, t, True), (2, 2.5, "x" * 300, None, True), (2, 2.5, "$5", None, True), (2, 2.5, "$5", None, True)]
    return spark.createDataFrame(rows, "i int, d double, s string, t timestamp_ntz, b boolean")


def test_equal_values_are_looked_at_once_and_counted_as_before(spark):
    df = _odd(spark)
    long = PF.long_values(df, ["s"])
    per_row, grouped = PF.column_stats(long, False), PF.text_stats(long)
    assert grouped.select(*per_row.columns).collect() == per_row.collect()
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2  # values first, then the rules
    empty = df.limit(0)
    assert PF.text_stats(PF.long_values(empty, ["s"])).collect() == []


def test_typed_values_are_counted_as_words(spark):
    df = _odd(spark)
    cols = df.columns
    want = {(r.ordinal, r.column): (r.distinct_ci, r.distinct_raw) for r in PF.distinct_counts(PF.long_values(df, cols)).collect()}
    assert {(r.ordinal, r.column): (r.distinct_ci, r.distinct_raw) for r in PF.all_distinct(df, cols).collect()} == want
    assert want[1, "d"] == (5, 5)  # both zeros, NaN, 1.5, 2.5
    assert "cast(i" not in PF.all_distinct(df, ["i", "t"])._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_filled_up_without_a_task_per_column(spark):
    df = spark.range(100).select(F.concat(F.lit("v"), F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("many"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the statistics are unknown
    try:
        plan = PF.profile(df).select("samples")
        assert "rightHint=(strategy=broadcast)" in plan._jdf.queryExecution().optimizedPlan().toString()
        assert plan.collect()[0].samples == ["v0", "v1", "v2"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sort_tasks_do_not_follow_the_ranges(spark, tmp_path):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") * 7919 % 3000).alias("v"))
    index = PG.PageIndex.build(df, ["-v"], str(tmp_path / "i"), range_rows=10)
    held = spark.read.parquet(f"{index.root}/index")
    assert held.count() == 300 and held.select("_range").distinct().count() == 1
    for n in (1, 7, 100, 429):
        assert [r.v for r in index.page(n, 7).collect()] == list(range(2999, -1, -1))[(n - 1) * 7:n * 7]


def test_pages_over_several_sort_tasks(spark, monkeypatch):
    monkeypatch.setattr(PG, "SORT_ROWS", 70)
    df = spark.range(0, 500, 1, 5).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    want = [tuple(r) for r in df.orderBy("k", "v").collect()]
    index = PG.PageIndex.build(df, ["k", "v"], range_rows=9)
    assert spark.read.parquet(f"{index.root}/index").select("_range").distinct().count() > 3
    for n in range(1, 23):
        assert [tuple(r) for r in index.page(n, 23).collect()] == want[(n - 1) * 23:n * 23]


def test_cells_are_not_compiled_into_one_method(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), 2.0), (2, None, None, None), (2, "a", dt.datetime(2024, 1, 3), 5.0)], "id long, k string, t timestamp_ntz, v double")
    kpis = [DB.Kpi("n", "", DB.Measure()), DB.Kpi("ids", "", DB.Measure("id", "distinct")), DB.Kpi("a", "", DB.Measure("v", "sum", DB.Condition("k", "in", ("a",))))]
    g = DB.grouped_cells(df, kpis, [DB.Chart("t", "", "line", "t", "v", "sum"), DB.Chart("k", "", "bar", "k")], "t", "7days")
    steps = [s for s in g._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in s]
    assert steps and all("*(" not in s for s in steps)
    got = {(r.item, r.part, r.key): (r.n, r.s, r.k) for r in g.collect()}
    assert got == {(0, 0, None): (1, 1.0, 1), (0, 2, None): (2, 2.0, 1), (2, 0, None): (3, None, 2), (4, 2, None): (2, 7.0, 1), (6, 0, "2024-01-01"): (1, 2.0, 1),
                   (6, 0, "2024-01-03"): (1, 5.0, 1), (7, 0, "a"): (2, 2.0, 1), (7, 0, None): (1, 1.0, 1)}
