"""Batched answers, pages, live tables and correlations on literal rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import analysis as AN
from tabulon.operators import paging as PG
from tabulon.operators import stats as ST
from tabulon.plans import answers as AW
from tabulon.streaming import live as LV

ROUTED = ("dataset_id string, question_id string, action string, metric string, group_by string, date_column string, period_type string, limit int, direction string, aggregation string")


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([1.5, 2.25, None, -3.0]), dt.datetime(2023, rng.randrange(1, 13), 3)) for _ in range(300)]
    return spark.createDataFrame(rows, "g string, v double, d timestamp_ntz")


def ask(spark, qs):
    return spark.createDataFrame(qs, ROUTED)


def test_answers_equal_those_of_the_single_operations(spark, shop):
    qs = [("shop", f"g{a}", "group_by", "v", "g", None, None, None, None, a) for a in ("sum", "avg", "min", "max", "count")]
    qs += [("shop", "t2", "top_n", "v", "g", None, None, 2, "desc", None), ("shop", "t0", "top_n", "v", "g", None, None, None, "asc", None), ("shop", "t99", "top_n", "v", "g", None, None, 99, "desc", None)]
    qs += [("shop", p, "compare_periods", "v", None, "d", p, None, None, None) for p in ("monthly", "quarterly", "yearly")]
    qs += [("shop", "none", "group_by", "v", None, None, None, None, None, "sum")]
    found = AW.answer(ask(spark, qs), lambda d: shop)
    got = {}
    for r in found.joined().collect():
        got.setdefault(r.question_id, []).append((r.position, r.key, r.value, r.change_pct))
    rows = lambda df: [tuple(r) for r in df.collect()]
    for a in ("sum", "avg", "min", "max", "count"):
        assert sorted((k, v) for _, k, v, _ in got[f"g{a}"]) == sorted(rows(AN.group_by(shop, "g", "v", a)))
    assert [(k, v) for _, k, v, _ in sorted(got["t2"])] == rows(AN.top_n(shop, "g", "v", 2))
    assert [(k, v) for _, k, v, _ in sorted(got["t0"])] == rows(AN.top_n(shop, "g", "v", 5, "asc"))
    assert len(got["t99"]) == 4
    for p in ("monthly", "quarterly", "yearly"):
        assert [(k, v, c) for _, k, v, c in sorted(got[p])] == [r[:3] for r in rows(AN.compare_periods(shop, "v", "d", p))]
    assert "none" not in got and found.questions.count() == len(qs)
    assert AW.answer(ask(spark, []), lambda d: shop).joined().collect() == []


def test_plan_does_not_grow_with_the_questions(spark, shop):
    one = [("shop", "q", "top_n", "v", "g", None, None, 2, "desc", None), ("shop", "r", "group_by", "v", "g", None, None, None, None, "avg")]
    loads = []
    plan = lambda qs: AW.answer(ask(spark, qs).repartition(2), lambda d: loads.append(d) or shop).joined()._jdf.queryExecution().optimizedPlan().toString()
    few = plan(one)
    many = plan([(d, f"{q}{i}", *rest) for i in range(400) for d, q, *rest in one])
    assert loads == ["shop", "shop"]  # one pass each
    assert few.count("Join") == many.count("Join") and len(few.splitlines()) == len(many.splitlines())


def test_pages(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), rng.choice(["x", "y", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(7)
    keys = ["-a", "b", "i"]
    want = [tuple(r) for r in df.orderBy(*PG.sort_columns(keys)).collect()]
    index = PG.PageIndex.build(df, keys, range_rows=60)
    assert index.pages(7) == 72
    for n in (1, 2, 9, 30, 72, 73, 1000):
        assert [tuple(r) for r in index.page(n, 7).collect()] == want[(n - 1) * 7:n * 7]
    plan = index.page(30, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    last, seen = None, []
    for _ in range(12):
        page = PG.next_page(df, keys, last, 50).collect()
        seen += [tuple(r) for r in page]
        last = page[-1].asDict() if page else last
    assert seen == want
    hot = PG.PageIndex.build(df.select(F.lit(1).alias("k"), "i"), ["k"], range_rows=100)  # all rows equal in the order
    assert max(r.n for r in spark.read.parquet(f"{hot.root}/index").collect()) < 300
    assert sorted(r.i for n in range(1, 51) for r in hot.page(n, 10).collect()) == list(range(500))
    assert PG.PageIndex.build(df.limit(0), keys).page(1).collect() == []


def test_live_table_of_files_sent_twice(spark, tmp_path):
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0) for i in range(24 * 6)], "id long, ts timestamp_ntz, v double")
    part = lambda lo, hi: ev.filter((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1)
    live = LV.LiveTable(spark, str(tmp_path / "in"), ev.schema, lambda s: LV.windowed_series(LV.once_each(s, "id", "ts"), "ts", "v", "sum", watermark=None))
    for rows in (part(0, 60), part(0, 60), part(66, 80), part(60, 66), part(80, 144), part(10, 20)):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        live.catch_up()
    got = {r.x: (r.y, r.n) for r in live.read().collect()}
    assert got == {f"2024-01-0{d}": (24.0, 24) for d in range(1, 5)}  # closed: at least a day before the last event


def test_correlations(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 4)) + 1e6
    m[:, 2] = 7.0
    m[:, 3] = m[:, 0] * 2 + m[:, 1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    got = {(r.variable, r.other): r.correlation for r in ST.correlation_matrix(df, df.columns).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.nan_to_num(np.corrcoef(m.T))
    names = df.columns
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert got[a, b] == pytest.approx(0.0 if "c" in (a, b) else want[i, j], abs=6e-4)
    assert {r.correlation for r in ST.correlation_matrix(df.limit(0), ["a", "b"]).collect()} == {0.0}
