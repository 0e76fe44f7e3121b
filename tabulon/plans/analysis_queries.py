"""Registered queries for the analysis operations, statistics, checks, rules,
filters and paging (A12-A16, A22-A24, A26, A28, A30, A32, G1-G6, F3, F9,
F10, T4, W1), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as AN
from ..operators import filters as FL
from ..operators import rules as RU
from ..operators import series as SR
from ..operators import stats as ST
from ..sources.tables import table
from .catalog_queries import r2, register, sql_r

# ---------------------------------------------------------------- A13-A16


@register("a13_group_by", f"""
SELECT COALESCE(CAST(o_orderpriority AS VARCHAR), 'Unknown') AS o_orderpriority,
       {sql_r('CASE WHEN COUNT(o_totalprice) = 0 THEN COUNT(*) ELSE SUM(o_totalprice) END')} AS o_totalprice
FROM orders GROUP BY 1
""")
def a13_group_by(spark, base):
    return AN.execute(table(spark, base, "orders"),
                      {"action": "group_by", "groupBy": "O_ORDERPRIORITY", "metric": "o_totalprice"})


@register("a13_group_by_count", """
SELECT COALESCE(CAST(c_mktsegment AS VARCHAR), 'Unknown') AS c_mktsegment, CAST(COUNT(*) AS DOUBLE) AS c_acctbal
FROM customer GROUP BY 1
""")
def a13_group_by_count(spark, base):
    return AN.group_by(table(spark, base, "customer"), "c_mktsegment", "c_acctbal", "count")


@register("a14_compare_periods", f"""
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS Period, SUM(COALESCE(o_totalprice, 0)) AS s, COUNT(*) AS n
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
q AS (SELECT *, LAG(s) OVER (ORDER BY Period) AS prev FROM p)
SELECT Period, {sql_r('s')} AS o_totalprice,
       CAST(CASE WHEN prev > 0 THEN FLOOR(({sql_r('s')} - prev) / prev * 100.0 + 0.5) ELSE 0 END AS DOUBLE) AS change_pct,
       n
FROM q
""")
def a14_compare_periods(spark, base):
    return AN.execute(table(spark, base, "orders"),
                      {"action": "compare_periods", "metric": "o_totalprice", "dateColumn": "o_orderdate"})


@register("a14_compare_quarters", f"""
WITH p AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS Period,
                  SUM(COALESCE(l_quantity, 0)) AS s, COUNT(*) AS n
           FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
q AS (SELECT *, LAG(s) OVER (ORDER BY Period) AS prev FROM p)
SELECT Period, {sql_r('s')} AS l_quantity,
       CAST(CASE WHEN prev > 0 THEN FLOOR(({sql_r('s')} - prev) / prev * 100.0 + 0.5) ELSE 0 END AS DOUBLE) AS change_pct,
       n
FROM q
""")
def a14_compare_quarters(spark, base):
    return AN.compare_periods(table(spark, base, "lineitem"), "l_quantity", "l_shipdate", "quarterly")


@register("a15_filter_agg", f"""
SELECT COALESCE(CAST(l_linestatus AS VARCHAR), 'Filtered Group') AS l_linestatus,
       {sql_r('SUM(COALESCE(l_quantity, 0))')} AS l_quantity
FROM lineitem WHERE contains(lower(COALESCE(CAST(l_returnflag AS VARCHAR), '')), 'r') GROUP BY 1
""")
def a15_filter_agg(spark, base):
    return AN.execute(table(spark, base, "lineitem"), {
        "action": "filter_and_aggregate", "filterColumn": "l_returnflag", "filterValue": "r",
        "metric": "l_quantity", "aggregation": "sum", "groupBy": "l_linestatus"})


@register("a15_filter_agg_nomatch", """
SELECT COALESCE(CAST(o_orderstatus AS VARCHAR), 'Filtered Group') AS o_orderstatus,
       CAST(COUNT(*) AS DOUBLE) AS o_totalprice
FROM orders WHERE contains(lower(COALESCE(CAST(o_orderpriority AS VARCHAR), '')), 'no such priority') GROUP BY 1
""")
def a15_filter_agg_nomatch(spark, base):
    return AN.filter_and_aggregate(table(spark, base, "orders"), "o_orderpriority", "no such priority",
                                   "o_totalprice", "count", "o_orderstatus")


@register("a16_top_n", f"""
SELECT COALESCE(c_name, 'Unknown') AS c_name, {sql_r('SUM(COALESCE(c_acctbal, 0))')} AS c_acctbal
FROM customer GROUP BY 1 ORDER BY c_acctbal DESC, c_name ASC LIMIT 10
""")
def a16_top_n(spark, base):
    return AN.execute(table(spark, base, "customer"),
                      {"action": "top_n", "groupBy": "c_name", "metric": "c_acctbal", "limit": 10})


@register("a16_top_n_asc", f"""
SELECT COALESCE(o_orderpriority, 'Unknown') AS o_orderpriority, {sql_r('SUM(COALESCE(o_totalprice, 0))')} AS o_totalprice
FROM orders GROUP BY 1 ORDER BY o_totalprice ASC, o_orderpriority ASC LIMIT 3
""")
def a16_top_n_asc(spark, base):
    return AN.top_n(table(spark, base, "orders"), "o_orderpriority", "o_totalprice", 3, "asc")


# ---------------------------------------------------------------- G1

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        va, vb = f"COALESCE(CAST({a} AS DOUBLE), 0)", f"COALESCE(CAST({b} AS DOUBLE), 0)"
        aggs.append(f"CASE WHEN STDDEV_POP({va}) * STDDEV_POP({vb}) = 0 THEN 0 ELSE "
                    f"COVAR_POP({va}, {vb}) / (STDDEV_POP({va}) * STDDEV_POP({vb})) END AS r{k}")
    sel = []
    for k, (a, b) in enumerate(pairs):
        sel.append(f"SELECT '{a}' AS variable, '{b}' AS other, {sql_r(f'COALESCE(r{k}, 0)', 3)} AS correlation FROM m")
        if a != b:
            sel.append(f"SELECT '{b}', '{a}', {sql_r(f'COALESCE(r{k}, 0)', 3)} FROM m")
    return "WITH m AS (SELECT " + ", ".join(aggs) + " FROM lineitem)\n" + "\nUNION ALL ".join(sel)


@register("g01_corr", _corr_sql(_CORR_COLS))
def g01_corr(spark, base):
    return ST.correlation_matrix(table(spark, base, "lineitem"), _CORR_COLS)


# ---------------------------------------------------------------- G2, W2

@register("g02_forecast", """
WITH s AS (SELECT strftime(o_orderdate, '%Y') AS x, COALESCE(SUM(o_totalprice), 0) AS y
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
p AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY x) - 1 AS DOUBLE) AS i, COALESCE(y, 0) AS v FROM s),
f AS (SELECT COUNT(*) AS n, COALESCE(REGR_SLOPE(v, i), 0) AS slope, SUM(i) AS sx, SUM(v) AS sy FROM p),
g AS (SELECT *, (sy - slope * sx) / n AS intercept FROM f WHERE n >= 2)
SELECT step, 'Forecast +' || CAST(step AS VARCHAR) AS x,
       CAST(FLOOR(GREATEST(slope * (n - 1 + step) + intercept, 0) + 0.5) AS DOUBLE) AS y
FROM g, range(1, 8) t(step)
""")
def g02_forecast(spark, base):
    s = SR.temporal_series(table(spark, base, "orders"), "o_orderdate", "o_totalprice", "sum", "year")
    return ST.forecast(s)


# ---------------------------------------------------------------- G3, G4

@register("g03_outliers", """
WITH s AS (SELECT strftime(l_shipdate, '%Y-%m') AS x, CAST(COUNT(*) AS DOUBLE) AS y
           FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
t AS (SELECT x, y, ROW_NUMBER() OVER (ORDER BY x) - 1 AS idx, AVG(y) OVER () AS mean,
             CASE WHEN STDDEV_POP(y) OVER () = 0 THEN 1 ELSE STDDEV_POP(y) OVER () END AS sd,
             COUNT(*) OVER () AS cnt FROM s)
SELECT idx, x, y, FLOOR((y - mean) / sd * 100 + 0.5) / 100 AS z,
       CASE WHEN y > mean THEN 'High' ELSE 'Low' END AS side
FROM t WHERE cnt >= 3 AND ABS((y - mean) / sd) > 1.8
""")
def g03_outliers(spark, base):
    s = SR.temporal_series(table(spark, base, "lineitem"), "l_shipdate", None, "count", "month")
    return ST.zscore_outliers(s)


@register("g04_sigma_outliers", f"""
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, {sql_r('SUM(o_totalprice)')} AS y
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
t AS (SELECT x, y, AVG(y) OVER () AS mean, STDDEV_POP(y) OVER () AS sd, COUNT(*) OVER () AS cnt FROM s)
SELECT x, y FROM t WHERE cnt > 2 AND sd > 0 AND ABS(y - mean) > 2 * sd
""")
def g04_sigma_outliers(spark, base):
    s = SR.round_y(SR.temporal_series(table(spark, base, "orders"), "o_orderdate", "o_totalprice", "sum", "month"))
    return ST.sigma_outliers(s)


# ---------------------------------------------------------------- G5

_CHART_POINTS_SQL = """
WITH pts AS (
  SELECT 'status_pie' AS chart_id, 'pie' AS chart_type, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT 'segment_bar', 'bar', CAST(COUNT(*) AS DOUBLE) FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'open_lines', 'bar', CAST(COUNT(*) AS DOUBLE) FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_linestatus
  UNION ALL SELECT 'nations_per_region', 'line', CAST(COUNT(*) AS DOUBLE) FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'flag_pie', 'pie', SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity * 1000 ELSE 0.001 END)
            FROM lineitem GROUP BY l_returnflag
)"""


def _chart_points(spark, base):
    o, c, li, n = (table(spark, base, t) for t in ("orders", "customer", "lineitem", "nation"))
    cnt = F.count(F.lit(1)).cast("double").alias("y")
    parts = [
        o.groupBy("o_orderstatus").agg(cnt).select(F.lit("status_pie").alias("chart_id"),
                                                   F.lit("pie").alias("chart_type"), "y"),
        c.groupBy("c_mktsegment").agg(cnt).select(F.lit("segment_bar").alias("chart_id"),
                                                  F.lit("bar").alias("chart_type"), "y"),
        li.filter(F.col("l_linestatus") == "O").groupBy("l_linestatus").agg(cnt)
        .select(F.lit("open_lines").alias("chart_id"), F.lit("bar").alias("chart_type"), "y"),
        n.groupBy("n_regionkey").agg(cnt).select(F.lit("nations_per_region").alias("chart_id"),
                                                 F.lit("line").alias("chart_type"), "y"),
        li.groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity") * 1000)
                                             .otherwise(F.lit(0.001))).alias("y"))
        .select(F.lit("flag_pie").alias("chart_id"), F.lit("pie").alias("chart_type"), "y"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("g05_chart_checks", _CHART_POINTS_SQL + """
, g AS (SELECT chart_id, COUNT(*) AS n, COUNT(y) AS nv, AVG(y) AS mean, STDDEV_POP(y) AS sd,
               SUM(ABS(y)) AS tot, MAX(ABS(y)) AS mx, ANY_VALUE(chart_type) AS ctype FROM pts GROUP BY chart_id
        UNION ALL SELECT 'no_points', 0, 0, NULL, NULL, NULL, NULL, 'pie' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'none')),
r AS (SELECT *, CASE WHEN n = 0 THEN 'Aggregation returned no data'
                     WHEN n < 2 THEN printf('Only %d data point(s) — chart requires at least %d', n, 2)
                     WHEN nv = 0 THEN 'All Y values are null, undefined, or NaN'
                     WHEN nv >= 2 AND ABS(mean) > 1e-10 AND sd / ABS(mean) < 0.001
                       THEN printf('Zero variance in Y values (all values ≈ %.4f) — chart conveys no information', mean)
                END AS reason FROM g)
SELECT chart_id, reason IS NULL AS valid, reason,
       CASE WHEN reason IS NULL AND contains(lower(ctype), 'pie') AND tot > 0 AND mx / tot > 0.95
            THEN 'One category accounts for > 95% of total — pie chart may not be informative' END AS warning
FROM r
""")
def g05_chart_checks(spark, base):
    points = _chart_points(spark, base)
    none = table(spark, base, "orders").filter("o_orderstatus = 'none'").select(
        F.lit("no_points").alias("chart_id"), F.lit("pie").alias("chart_type"), F.col("o_totalprice").alias("y"))
    charts = spark.createDataFrame([("status_pie", "pie"), ("segment_bar", "bar"), ("open_lines", "bar"), ("nations_per_region", "line"),
                                    ("flag_pie", "pie"), ("no_points", "pie")], "chart_id string, chart_type string")
    return ST.chart_checks(points.unionByName(none), charts=charts)


# ---------------------------------------------------------------- G6

@register("g06_kpi_checks", f"""
WITH k AS (SELECT SUM(l_extendedprice) AS total, AVG(l_discount) AS avg_disc,
                  AVG(CASE WHEN l_quantity < 0 THEN l_quantity END) AS neg_avg FROM lineitem),
r AS (SELECT 'total_price' AS kpi, total AS v FROM k UNION ALL SELECT 'avg_discount', avg_disc FROM k
      UNION ALL SELECT 'avg_negative_qty', neg_avg FROM k)
SELECT kpi, {sql_r('v', 4)} AS value, v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AS valid,
       CASE WHEN v IS NULL THEN 'null value' WHEN isnan(v) THEN 'value is NaN' WHEN isinf(v) THEN 'value is Infinity' END
         AS reason
FROM r
""")
def g06_kpi_checks(spark, base):
    li = table(spark, base, "lineitem")
    row = li.agg(F.sum("l_extendedprice").alias("total_price"), F.avg("l_discount").alias("avg_discount"),
                 F.avg(F.when(F.col("l_quantity") < 0, F.col("l_quantity"))).alias("avg_negative_qty"))
    kv = row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("v"))
                                       for k in ("total_price", "avg_discount", "avg_negative_qty")])))
    chk = ST.kpi_check("v")
    return kv.select("kpi", r2("v", 4).alias("value"), chk.getField("valid").alias("valid"),
                     chk.getField("reason").alias("reason"))


# ---------------------------------------------------------------- A22, F6, F8

@register("a22_rule_alerts", """
SELECT * FROM (
  SELECT 'negative-profit' AS rule_id, 'Negative balance' AS label, 'c_acctbal' AS "column",
         COUNT(CASE WHEN c_acctbal < 0 THEN 1 END) AS triggered_count, 'warning' AS severity FROM customer
  UNION ALL SELECT 'high-expense', 'High balance', 'c_acctbal', COUNT(CASE WHEN c_acctbal > 5000 THEN 1 END), 'info'
  FROM customer
  UNION ALL SELECT 'zero-balance', 'Zero balance', 'c_acctbal', COUNT(CASE WHEN c_acctbal = 1234567 THEN 1 END), 'info'
  FROM customer
  UNION ALL SELECT 'rich-industrial', 'Rich industrial', 'c_acctbal',
         COUNT(CASE WHEN c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 END), 'critical'
  FROM customer
  UNION ALL SELECT 'not-household', 'Not household', 'c_mktsegment',
         COUNT(CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 1 END), 'info' FROM customer
) WHERE triggered_count > 0
""")
def a22_rule_alerts(spark, base):
    c = table(spark, base, "customer")
    return RU.rule_alerts(c, [
        RU.Rule("negative-profit", "Negative balance", "c_acctbal", 0, "<"),
        RU.Rule("high-expense", "High balance", "c_acctbal", 5000, ">"),
        RU.Rule("zero-balance", "Zero balance", "c_acctbal", 1234567, "=="),
        RU.Rule("rich-industrial", "Rich industrial", "c_acctbal", 9000, ">", "critical",
                in_column="c_mktsegment", in_values=["BUILDING", "MACHINERY"]),
        RU.Rule("not-household", "Not household", "c_mktsegment", "HOUSEHOLD", "!="),
    ])


# ---------------------------------------------------------------- A23

@register("a23_frequencies", """
WITH g AS (SELECT CAST(o_orderpriority AS VARCHAR) AS value, COUNT(*) AS n FROM orders GROUP BY 1),
t AS (SELECT value FROM g ORDER BY n DESC, value ASC LIMIT 1)
SELECT g.value, g.n, g.value IS NOT DISTINCT FROM (SELECT value FROM t) AS is_top FROM g
""")
def a23_frequencies(spark, base):
    return SR.category_frequencies(table(spark, base, "orders"), "o_orderpriority")


# ---------------------------------------------------------------- A24

@register("a24_weekend", """
WITH v AS (SELECT ts, CASE WHEN value IS NULL OR value = 0 OR isnan(value) THEN 1.0 ELSE value END AS v
           FROM events WHERE ts IS NOT NULL),
a AS (SELECT AVG(CASE WHEN dayofweek(ts) IN (0, 6) THEN v END) AS awe,
             AVG(CASE WHEN dayofweek(ts) NOT IN (0, 6) THEN v END) AS awd,
             COUNT(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 END) AS weekend_rows,
             COUNT(CASE WHEN dayofweek(ts) NOT IN (0, 6) THEN 1 END) AS weekday_rows FROM v),
b AS (SELECT *, CASE WHEN weekend_rows > 0 AND weekday_rows > 0 AND awd > 0
                     THEN FLOOR((awe - awd) / awd * 100.0 + 0.5) END AS pct FROM a)
SELECT FLOOR(awe * 100 + 0.5) / 100 AS avg_weekend, FLOOR(awd * 100 + 0.5) / 100 AS avg_weekday,
       CAST(pct AS DOUBLE) AS pct_diff, pct > 0 AS is_higher, weekend_rows, weekday_rows FROM b
""")
def a24_weekend(spark, base):
    return ST.weekend_vs_weekday(table(spark, base, "events"), "ts", "value")


# ---------------------------------------------------------------- A26, A32, A30, W1

_MONTHLY_SQL = f"""
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, {sql_r('SUM(o_totalprice)')} AS y
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""


def _monthly(spark, base):
    return SR.round_y(SR.temporal_series(table(spark, base, "orders"), "o_orderdate", "o_totalprice", "sum", "month"))


@register("a26_series_summary", _MONTHLY_SQL + f""",
a AS (SELECT SUM(y) AS total, AVG(y) AS mean, MEDIAN(y) AS median, COUNT(*) AS points, STDDEV_POP(y) AS sd,
             ARG_MIN(y, x) AS first_y, ARG_MAX(y, x) AS last_y FROM s),
hi AS (SELECT x, y FROM s ORDER BY y DESC, x ASC LIMIT 1),
lo AS (SELECT x, y FROM s ORDER BY y ASC, x ASC LIMIT 1),
o AS (SELECT COUNT(*) AS n_out FROM s, a WHERE ABS(s.y - a.mean) > 2 * a.sd)
SELECT {sql_r('total')} AS total, {sql_r('mean', 6)} AS mean, {sql_r('median', 6)} AS median, points,
       hi.x AS highest_x, {sql_r('hi.y')} AS highest_y, lo.x AS lowest_x, {sql_r('lo.y')} AS lowest_y,
       {sql_r('CASE WHEN hi.y > 0 AND total > 0 THEN hi.y / total * 100 END')} AS highest_share_pct,
       COALESCE(CASE WHEN hi.y > 0 AND total > 0 THEN hi.y / total * 100 END, 0) >= 30 AS highest_is_notable,
       {sql_r('CASE WHEN points >= 2 AND first_y <> 0 THEN (last_y - first_y) / first_y * 100 ELSE 0 END')} AS growth_pct,
       CAST(CASE WHEN points > 2 AND sd > 0 THEN n_out ELSE 0 END AS BIGINT) AS outliers
FROM a, hi, lo, o
""")
def a26_series_summary(spark, base):
    return ST.series_summary(_monthly(spark, base))


@register("a32_share_of_max", f"""
WITH g AS (SELECT l_suppkey AS x, {sql_r('SUM(l_extendedprice)')} AS y FROM lineitem GROUP BY 1),
t AS (SELECT * FROM g ORDER BY y DESC, x ASC LIMIT 10)
SELECT x, y, {sql_r('CASE WHEN (SELECT MAX(y) FROM g) <> 0 THEN y / (SELECT MAX(y) FROM g) * 100 ELSE 0 END', 4)} AS share
FROM t
""")
def a32_share_of_max(spark, base):
    g = SR.round_y(SR.group_aggregate(table(spark, base, "lineitem"), "l_suppkey", "l_extendedprice", "sum")
                   .select("x", "y"))
    return SR.share_of_max(g).withColumn("share", r2("share", 4))


@register("a30_pct_distribution", f"""
WITH g AS (SELECT o_orderstatus AS x, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY 1)
SELECT x, y, {sql_r('y / (SELECT SUM(y) FROM g) * 100.0', 4)} AS pct FROM g
""")
def a30_pct_distribution(spark, base):
    g = SR.group_aggregate(table(spark, base, "orders"), "o_orderstatus", None, "count").select("x", "y")
    return SR.percentage_distribution(g).withColumn("pct", r2("pct", 4))


@register("w01_prev_change", _MONTHLY_SQL + f"""
SELECT x, y, LAG(y) OVER (ORDER BY x) AS prev_y,
       {sql_r('CASE WHEN LAG(y) OVER (ORDER BY x) <> 0 THEN (y - LAG(y) OVER (ORDER BY x)) / ABS(LAG(y) OVER (ORDER BY x)) * 100.0 END', 4)} AS change_pct
FROM s
""")
def w01_prev_change(spark, base):
    s = SR.previous_change(_monthly(spark, base).select("x", "y"))
    return s.withColumn("change_pct", r2("change_pct", 4))


# ---------------------------------------------------------------- A12, A28

@register("a12_naive_date", f"""
SELECT CAST(o_orderdate AS VARCHAR) AS x, CAST(COUNT(*) AS DOUBLE) AS y, COUNT(*) AS n
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def a12_naive_date(spark, base):
    return SR.naive_date_group(table(spark, base, "orders"), "o_orderdate", None, "count")


@register("a28_ui_kpi", f"""
WITH v AS (SELECT COALESCE(TRY_CAST(NULLIF(regexp_replace(CAST(c_acctbal AS VARCHAR), '[^0-9.\\-]', '', 'g'), '') AS DOUBLE), 0) AS v
           FROM customer)
SELECT {sql_r('SUM(v)')} AS sum_value, {sql_r('AVG(v)', 6)} AS avg_value, CAST(COUNT(*) AS DOUBLE) AS count_value FROM v
""")
def a28_ui_kpi(spark, base):
    k = SR.ui_kpis(table(spark, base, "customer"), "c_acctbal")
    return k.select(r2("sum_value").alias("sum_value"), r2("avg_value", 6).alias("avg_value"), "count_value")


# ---------------------------------------------------------------- F3, F9, F10, T4

@register("f03_contains", """
SELECT p_partkey AS x, p_retailprice AS y FROM part
WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'eco')
ORDER BY x, y LIMIT 100
""")
def f03_contains(spark, base):
    p = FL.contains_all(table(spark, base, "part"), {"p_name": "RING", "p_type": "eco", "p_brand": ""})
    return FL.capped_projection(p, "p_partkey", "p_retailprice", 100)


@register("t04_page", """
SELECT * FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')
ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 10 OFFSET 10
""")
def t04_page(spark, base):
    p = FL.any_column_search(table(spark, base, "part"), "Ring", ["p_name", "p_brand", "p_type"])
    return FL.page(p, 2, 10, F.desc("p_retailprice"), F.asc("p_partkey"))


@register("t01_mixed_sort", """
SELECT * FROM (
  SELECT n_name AS k, n_nationkey AS tie FROM nation
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_regionkey + 100 FROM region)
ORDER BY TRY_CAST(k AS DOUBLE) ASC NULLS LAST, lower(k) ASC NULLS LAST, tie ASC
""")
def t01_mixed_sort(spark, base):
    n = table(spark, base, "nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("tie"))
    r = table(spark, base, "region").select(F.col("r_regionkey").cast("string").alias("k"),
                                            (F.col("r_regionkey") + 100).alias("tie"))
    return FL.sort_mixed(n.unionByName(r), "k", True, "tie")
