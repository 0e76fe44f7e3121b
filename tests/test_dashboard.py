"""Dashboards compiled from specs: equal to the single operators, one scan, odd data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.operators import dashboard as DB
from tabulon.operators import periods as PD
from tabulon.operators import series as SR
from tabulon.sources.tables import table

SF = "/root/testdata/sf0.001"
K, M, C = DB.Kpi, DB.Measure, DB.Chart
KPIS = [K("revenue", "Revenue", M("o_totalprice", "sum"), format="currency"), K("mean", "Mean", M("o_totalprice", "avg")), K("least", "Least", M("o_totalprice", "min")),
        K("most", "Most", M("o_totalprice", "max")), K("orders", "Orders", M("o_orderkey", "count")), K("customers", "Customers", M("o_custkey", "distinct")),
        K("statuses", "Statuses", M("o_orderstatus", "distinct"))]


def rounded(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("window", [None, "30days", "7days"])
def test_cards_equal_those_of_the_single_operator(spark, window):
    o = table(spark, SF, "orders")
    got = DB.compile_dashboard(o, KPIS, [], "o_orderdate", window).cards
    want = PD.kpi_cards(o, [PD.KpiSpec(k.kpi, k.measure.column, k.measure.aggregation) for k in KPIS], "o_orderdate", window)
    cols = ["kpi", "value", "all_time", "current_value", "prior_value", "current_count", "prior_count", "delta_pct", "delta_direction", "period"]
    rows = lambda df: sorted(tuple(rounded(r[c]) for c in cols) for r in df.collect())
    assert rows(got) == rows(want)


def test_charts_equal_those_of_the_single_operators(spark):
    o = table(spark, SF, "orders")
    charts = [C("t", "t", "line", "o_orderdate", "o_totalprice", "avg"), C("c", "c", "bar", "o_orderpriority", "o_totalprice", "max"),
              C("many", "many", "bar", "o_custkey", "o_totalprice", "sum"), C("manyavg", "many", "bar", "o_custkey", "o_totalprice", "avg"),
              C("n", "n", "bar", "o_custkey"), C("days", "days", "line", "o_orderdate", DB.ROWS, "count"), C("s", "s", "scatter", "o_totalprice", "o_custkey", "none")]
    d = DB.compile_dashboard(o, [], charts, checked=False)
    got = {}
    for r in d.points.collect():
        got.setdefault(r.chart, []).append((r.position, r.x, rounded(r.y), r.n))
    rows = lambda df: [(r.x, rounded(r.y), r.n) for r in df.collect()]
    plain = lambda name: [p[1:] for p in sorted(got[name])]
    assert plain("t") == rows(SR.temporal_series(o, "o_orderdate", "o_totalprice", "avg"))
    assert plain("c") == rows(SR.group_aggregate(o, "o_orderpriority", "o_totalprice", "max"))
    for name, y, agg in (("many", "o_totalprice", "sum"), ("manyavg", "o_totalprice", "avg"), ("n", None, "count")):
        want = SR.top_with_other(o, "o_custkey", y, agg).orderBy("rank")
        assert plain(name) == rows(want) and len(got[name]) == 100
    assert plain("s") == [(str(r.x), float(r.y), 1) for r in o.select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y")).orderBy("x", "y").limit(100).collect()]
    ahead = [r for r in d.forecasts.collect() if r.chart == "t"]
    assert sorted(r.step for r in ahead) == list(range(1, 8))


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_one_scan_of_the_needed_columns(spark):
    o = table(spark, SF, "orders")
    charts = [C("t", "t", "line", "o_orderdate", "o_totalprice", "sum"), C("c", "c", "bar", "o_orderpriority")]
    lo, hi = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    g = DB.grouped_cells(o, KPIS[:6], charts, "o_orderdate", "30days", {"o_orderdate": (lo, hi)})
    assert scans(g) == 1
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan  # no spec names it
    known = DB.compile_dashboard(o, KPIS, charts, "o_orderdate", "30days", {"o_orderdate": (lo, hi)})
    read = DB.compile_dashboard(o, KPIS, charts, "o_orderdate", "30days")
    for a, b in ((known.cards, read.cards), (known.points, read.points), (known.forecasts, read.forecasts)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_conditions_and_shares(spark):
    rows = [("Active", None, 10.0), ("active", None, 20.0), ("Left", dt.datetime(2024, 5, 1), 30.0), (None, None, None), ("Left", dt.datetime(2024, 6, 1), 0.0)]
    df = spark.createDataFrame(rows, "status string, exit_date timestamp_ntz, pay double")
    active = DB.Condition("status", "in", ("Active", "active"))
    kpis = [K("active", "Active", M("status", "count", active)), K("left", "Left", M("status", "count", DB.Condition("status", "not in", active.values)), M(), "percent"),
            K("gone", "Gone", M("exit_date", "count", DB.Condition("exit_date", "present")), M(), "percent"),
            K("pay", "Pay of active", M("pay", "avg", active)), K("share", "Share of pay", M("pay", "sum", active), M("pay", "sum")), K("kinds", "Kinds", M("status", "distinct", DB.Condition("pay", "present")))]
    got = {r.kpi: r.value for r in DB.compile_dashboard(df, kpis, []).cards.collect()}
    assert got == {"active": 2.0, "left": 40.0, "gone": 40.0, "pay": 15.0, "share": 0.5, "kinds": 3.0}
    none = {r.kpi: r.value for r in DB.compile_dashboard(df.limit(0), kpis, [C("c", "c", "bar", "status")]).cards.collect()}
    assert none == dict.fromkeys(got, 0.0)


def test_odd_data(spark):
    df = spark.createDataFrame([(None, None, None), ("a", None, "x"), ("a", 1.0, None), (" ", 2.0, "Other"), ("b", float("nan"), "x")], "g string, v double, s string")
    d = DB.compile_dashboard(df, [K("k", "k", M("v", "max"))], [C("g", "g", "bar", "g", "v", "sum"), C("split", "split", "bar", "g", "v", "count", "s", 1)], checked=False)
    pts = d.points.collect()
    assert {(r.x, r.n) for r in pts if r.chart == "g"} == {(None, 1), ("a", 2), (" ", 1), ("b", 1)}
    assert {(r.x, r.series, r.n) for r in pts if r.chart == "split"} == {(None, "Other", 1), ("a", "x", 1), ("a", "Other", 1), (" ", "Other", 1), ("b", "x", 1)}
    assert DB.compile_dashboard(df, [K("k", "k", M("v", "max"))], []).cards.count() == 0  # NaN is no KPI value
    with pytest.raises(ValueError, match="no_such"):
        DB.compile_dashboard(df, [], [C("c", "c", "bar", "no_such")])
    with pytest.raises(ValueError, match="mode"):
        DB.compile_dashboard(df, [K("k", "k", M("v", "mode"))], [])


def plain_series(rows, cap):
    total = {}
    for _, s, v in rows:
        if s != "Other":
            total[s] = total.get(s, 0.0) + v
    top = sorted(total, key=lambda s: (-total[s], s))[:cap]
    out = {}
    for x, s, v in rows:
        k = top.index(s) + 1 if s in top else cap + 1
        y, n = out.setdefault(x, {}).get(k, (0.0, 0))
        out[x][k] = (y + v, n + 1)
    return top, out


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_top_series(spark, cap):
    rows = [(f"x{i % 4}", None if i % 13 == 0 else "Other" if i % 11 == 0 else f"s{(i * i) % 17}", float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "x string, s string, v double").repartition(5)
    top, want = plain_series([(x, s or "Other", v) for x, s, v in rows], cap)
    for agg in ("sum", "avg"):
        got = SR.top_series(df, "x", "s", "v", agg, cap).collect()
        assert len(got) == 4
        for r in got:
            assert [r[f"label_{k}"] for k in range(1, cap + 1)] == top + [None] * (cap - len(top))
            for k in [*range(1, cap + 1), "other"]:
                y, n = want[r.x].get(cap + 1 if k == "other" else k, (None, None))
                assert r[f"n_{k}"] == n and (r[f"y_{k}"] is None if n is None else abs(r[f"y_{k}"] - (y / n if agg == "avg" else y)) < 1e-9)
    assert SR.top_series(df.limit(0), "x", "s", "v").collect() == []
