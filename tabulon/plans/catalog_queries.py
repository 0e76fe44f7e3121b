"""Registered queries over the warehouse tables, one per operator family of
the coverage list, each with an equivalent DuckDB SQL text (the oracle).

Every query reads whole tables from ``base`` (a folder of parquet files) and
returns a lazy DataFrame.  Floating results are rounded the same way on both
sides (``floor(x * 10^d + 0.5) / 10^d``) so that summation order does not
change the compared values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import js_round
from ..operators import filters as FL
from ..operators import periods as PD
from ..operators import series as SR
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r2(c, d=2):
    return js_round(c, d)


def sql_r(expr: str, d: int = 2) -> str:
    p = float(10 ** d)
    return f"(FLOOR(({expr}) * {p} + 0.5) / {p})"


# ---------------------------------------------------------------- A9, F1, T1

@register("a09_group_sum", f"""
SELECT l_returnflag AS x, {sql_r('SUM(l_extendedprice)')} AS y, COUNT(*) AS n
FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag
""")
def a09_group_sum(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem")
    li = FL.equality_filters(li, {"L_LINESTATUS": "O", "unknown_col": "z", "l_tax": ""})
    return SR.round_y(SR.group_aggregate(li, "l_returnflag", "l_extendedprice", "sum"))


# ---------------------------------------------------------------- A1, A27, A30

@register("a01_kpi_agg", f"""
SELECT {sql_r('SUM(l_extendedprice)')} AS sum_price,
       {sql_r('AVG(l_extendedprice)', 6)} AS avg_price,
       MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price,
       QUANTILE_DISC(l_extendedprice, 0.5) AS median_price,
       COUNT(l_extendedprice) AS n_values, COUNT(*) AS n_rows,
       {sql_r('SUM(l_quantity)')} AS sum_qty, {sql_r('AVG(l_discount)', 6)} AS avg_discount
FROM lineitem
""")
def a01_kpi_agg(spark, base):
    li = table(spark, base, "lineitem")
    row = SR.kpi_aggregates(li, [
        ("sum_price", "l_extendedprice", "sum"), ("avg_price", "l_extendedprice", "avg"),
        ("min_price", "l_extendedprice", "min"), ("max_price", "l_extendedprice", "max"),
        ("median_price", "l_extendedprice", "median"),
        ("n_values", "l_extendedprice", "count_values"), ("n_rows", None, "count"),
        ("sum_qty", "l_quantity", "sum"), ("avg_discount", "l_discount", "avg"),
    ])
    return row.select(r2("sum_price").alias("sum_price"), r2("avg_price", 6).alias("avg_price"),
                      "min_price", "max_price", "median_price",
                      F.col("n_values").cast("long").alias("n_values"),
                      F.col("n_rows").cast("long").alias("n_rows"),
                      r2("sum_qty").alias("sum_qty"), r2("avg_discount", 6).alias("avg_discount"))


# ---------------------------------------------------------------- A2-A8, F2, F7

_KPI_SQL = """
WITH b AS (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders),
p AS (SELECT make_timestamp(epoch_us(hi) - {span}) AS cs, make_timestamp(epoch_us(hi) - 2 * {span}) AS ps,
             lo <> hi AS has FROM b),
f AS (SELECT o.*, o_orderdate >= cs AS cur, o_orderdate >= ps AND o_orderdate < cs AS pri, has FROM orders o, p),
plain AS (
  SELECT 'revenue' AS kpi, 'sum' AS agg, SUM(o_totalprice) AS a,
         SUM(CASE WHEN cur THEN o_totalprice END) AS c, SUM(CASE WHEN pri THEN o_totalprice END) AS p,
         COUNT(CASE WHEN cur AND o_totalprice IS NOT NULL THEN 1 END) AS cn,
         COUNT(CASE WHEN pri AND o_totalprice IS NOT NULL THEN 1 END) AS pn, ANY_VALUE(has) AS has FROM f
  UNION ALL
  SELECT 'avg_order', 'avg', AVG(o_totalprice), AVG(CASE WHEN cur THEN o_totalprice END),
         AVG(CASE WHEN pri THEN o_totalprice END),
         COUNT(CASE WHEN cur AND o_totalprice IS NOT NULL THEN 1 END),
         COUNT(CASE WHEN pri AND o_totalprice IS NOT NULL THEN 1 END), ANY_VALUE(has) FROM f
  UNION ALL
  SELECT 'orders', 'count', COUNT(*), COUNT(CASE WHEN cur THEN 1 END), COUNT(CASE WHEN pri THEN 1 END),
         COUNT(CASE WHEN cur AND o_orderkey IS NOT NULL THEN 1 END),
         COUNT(CASE WHEN pri AND o_orderkey IS NOT NULL THEN 1 END), ANY_VALUE(has) FROM f
  UNION ALL
  SELECT 'customers', 'distinct', COUNT(DISTINCT o_custkey), COUNT(DISTINCT CASE WHEN cur THEN o_custkey END),
         COUNT(DISTINCT CASE WHEN pri THEN o_custkey END), COUNT(DISTINCT CASE WHEN cur THEN o_custkey END),
         COUNT(DISTINCT CASE WHEN pri THEN o_custkey END), ANY_VALUE(has) FROM f
),
cmp AS (
  SELECT kpi, agg, a, CASE WHEN agg = 'distinct' THEN a ELSE COALESCE(CASE WHEN has THEN c ELSE a END, 0) END AS value,
         COALESCE(c, 0) AS cur, COALESCE(p, 0) AS pri, cn, pn, has FROM plain
)
SELECT kpi, agg, {r_value} AS value, {r_all} AS all_time, {r_cur} AS current_value, {r_pri} AS prior_value,
       cn AS current_count, pn AS prior_count,
       CASE WHEN NOT has OR cn = 0 OR pn = 0 THEN NULL
            WHEN pri = 0 THEN CASE WHEN cur > 0 THEN 100.0 ELSE 0.0 END
            ELSE FLOOR((cur - pri) / ABS(pri) * 1000.0 + 0.5) / 10.0 END AS delta_pct,
       CASE WHEN NOT has OR cn = 0 OR pn = 0 THEN 'flat'
            WHEN pri = 0 THEN CASE WHEN cur > 0 THEN 'up' ELSE 'flat' END
            WHEN cur > pri THEN 'up' WHEN cur < pri THEN 'down' ELSE 'flat' END AS delta_direction,
       CASE WHEN NOT has THEN NULL WHEN cn = 0 THEN 'No data for this period'
            WHEN pn = 0 THEN 'No prior period data for comparison' ELSE 'vs prior period' END AS period
FROM cmp
""".format(span=30 * 86400 * 1_000_000, r_value=sql_r("value"), r_all=sql_r("a"),
           r_cur=sql_r("cur"), r_pri=sql_r("pri"))


@register("a07_kpi_cards", _KPI_SQL)
def a07_kpi_cards(spark, base):
    o = table(spark, base, "orders")
    cards = PD.kpi_cards(o, [
        PD.KpiSpec("revenue", "o_totalprice", "sum", "Revenue"),
        PD.KpiSpec("avg_order", "o_totalprice", "avg", "Average order"),
        PD.KpiSpec("orders", "o_orderkey", "count", "Orders"),
        PD.KpiSpec("customers", "o_custkey", "distinct", "Customers"),
    ], date_col="o_orderdate", window="30days")
    return cards.select("kpi", "agg", r2("value").alias("value"), r2("all_time").alias("all_time"),
                        r2("current_value").alias("current_value"), r2("prior_value").alias("prior_value"),
                        "current_count", "prior_count", "delta_pct", "delta_direction", "period")


# ---------------------------------------------------------------- A4, A10, A11

@register("a10_temporal_orders", f"""
SELECT strftime(o_orderdate, '%Y') AS x, {sql_r('SUM(o_totalprice)')} AS y, COUNT(*) AS n,
       'year' AS granularity
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def a10_temporal_orders(spark, base):
    o = table(spark, base, "orders")
    return SR.round_y(SR.temporal_series(o, "o_orderdate", "o_totalprice", "sum"))


@register("a10_temporal_events", f"""
SELECT strftime(ts, '%Y-%m-%d') AS x, {sql_r('AVG(value)', 6)} AS y, COUNT(*) AS n, 'day' AS granularity
FROM events WHERE ts IS NOT NULL GROUP BY 1
""")
def a10_temporal_events(spark, base):
    e = table(spark, base, "events")
    return SR.round_y(SR.temporal_series(e, "ts", "value", "avg"), 6)


@register("a10_temporal_weeks", f"""
SELECT isoyear(l_shipdate) || '-W' || lpad(CAST(weekofyear(l_shipdate) AS VARCHAR), 2, '0') AS x,
       {sql_r('SUM(l_quantity)')} AS y, COUNT(*) AS n, 'week' AS granularity
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1
""")
def a10_temporal_weeks(spark, base):
    li = table(spark, base, "lineitem")
    return SR.round_y(SR.temporal_series(li, "l_shipdate", "l_quantity", "sum", granularity="week"))


@register("a10_temporal_quarters", f"""
SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS x,
       MAX(o_totalprice) AS y, COUNT(*) AS n, 'quarter' AS granularity
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def a10_temporal_quarters(spark, base):
    o = table(spark, base, "orders")
    return SR.temporal_series(o, "o_orderdate", "o_totalprice", "max", granularity="quarter")


# ---------------------------------------------------------------- T2

@register("t02_top_other", f"""
WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS x, SUM(l_extendedprice) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY y DESC NULLS LAST, x ASC NULLS FIRST) AS rank,
             COUNT(*) OVER () AS groups FROM g)
SELECT x, {sql_r('y')} AS y, n, rank FROM r WHERE rank < 100 OR groups <= 100
UNION ALL
SELECT 'Other', {sql_r('SUM(y)')}, SUM(n), 100 FROM r WHERE rank >= 100 AND groups > 100 HAVING COUNT(*) > 0
""")
def t02_top_other(spark, base):
    li = table(spark, base, "lineitem")
    return SR.round_y(SR.top_with_other(li, "l_partkey", "l_extendedprice", "sum"))


@register("t02_top_other_avg", f"""
WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS x, AVG(o_totalprice) AS y, COUNT(*) AS n,
                  SUM(o_totalprice) AS s, COUNT(o_totalprice) AS c FROM orders GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY y DESC NULLS LAST, x ASC NULLS FIRST) AS rank,
             COUNT(*) OVER () AS groups FROM g)
SELECT x, {sql_r('y', 4)} AS y, n, rank FROM r WHERE rank < 100 OR groups <= 100
UNION ALL
SELECT 'Other', {sql_r('SUM(s) / SUM(c)', 4)}, SUM(n), 100 FROM r WHERE rank >= 100 AND groups > 100
HAVING COUNT(*) > 0
""")
def t02_top_other_avg(spark, base):
    o = table(spark, base, "orders")
    return SR.round_y(SR.top_with_other(o, "o_custkey", "o_totalprice", "avg"), 4)


# ---------------------------------------------------------------- A17, A18

@register("a17_pivot", f"""
SELECT COALESCE(NULLIF(TRIM(o_orderpriority), ''), '(Blank)') AS x,
       COALESCE(NULLIF(TRIM(o_orderstatus), ''), 'Other') AS series,
       {sql_r('SUM(COALESCE(o_totalprice, 0))')} AS y,
       COUNT(*) AS n
FROM orders GROUP BY 1, 2
""")
def a17_pivot(spark, base):
    o = table(spark, base, "orders")
    return SR.round_y(SR.series_long(o, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum"))


# ---------------------------------------------------------------- A20

@register("a20_histogram", """
WITH v AS (SELECT p_retailprice AS v FROM part WHERE p_retailprice IS NOT NULL),
b AS (SELECT MIN(v) AS lo, MAX(v) AS hi, CASE WHEN MAX(v) = MIN(v) THEN 1.0 ELSE (MAX(v) - MIN(v)) / 10.0 END AS w FROM v),
c AS (SELECT CAST(LEAST(FLOOR((v - lo) / w), 9) AS INTEGER) AS bin, COUNT(*) AS y FROM v, b GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT bins.bin, CAST(CAST(FLOOR(lo + bins.bin * w + 0.5) AS BIGINT) AS VARCHAR) || '-' ||
       CAST(CAST(FLOOR(lo + bins.bin * w + w + 0.5) AS BIGINT) AS VARCHAR) AS x,
       FLOOR((lo + bins.bin * w) * 1000000.0 + 0.5) / 1000000.0 AS bin_start,
       FLOOR((lo + bins.bin * w + w) * 1000000.0 + 0.5) / 1000000.0 AS bin_end,
       COALESCE(c.y, 0) AS y
FROM bins CROSS JOIN b LEFT JOIN c ON c.bin = bins.bin WHERE b.lo IS NOT NULL
""")
def a20_histogram(spark, base):
    p = table(spark, base, "part")
    h = SR.histogram(p, "p_retailprice", 10)
    return h.withColumn("bin_start", r2("bin_start", 6)).withColumn("bin_end", r2("bin_end", 6))


# ---------------------------------------------------------------- A21

@register("a21_filter_options", """
WITH long AS (
  SELECT 'o_orderstatus' AS "column", CAST(o_orderstatus AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders
  UNION ALL SELECT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR) FROM customer
  UNION ALL SELECT 'p_brand', CAST(p_brand AS VARCHAR) FROM part
), d AS (SELECT DISTINCT "column", value FROM long WHERE value IS NOT NULL AND value <> '')
SELECT "column", value, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value) AS rank FROM d) WHERE rank <= 25
""")
def a21_filter_options(spark, base):
    o = SR.filter_options(table(spark, base, "orders"), ["o_orderstatus", "o_orderpriority"])
    c = SR.filter_options(table(spark, base, "customer"), ["c_mktsegment"])
    p = SR.filter_options(table(spark, base, "part"), ["p_brand"])
    return o.unionByName(c).unionByName(p)


# ---------------------------------------------------------------- A25, A5

@register("a25_half_growth", """
WITH b AS (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders),
m AS (SELECT make_timestamp(epoch_us(lo) + CAST(FLOOR((epoch_us(hi) - epoch_us(lo)) / 2) AS BIGINT)) AS mid FROM b),
s AS (SELECT COALESCE(SUM(CASE WHEN o_orderdate < mid THEN o_totalprice END), 0) AS f,
             COALESCE(SUM(CASE WHEN o_orderdate >= mid THEN o_totalprice END), 0) AS s
      FROM orders, m WHERE o_orderdate IS NOT NULL)
SELECT 'o_totalprice' AS metric, FLOOR(f * 100 + 0.5) / 100 AS first_half, FLOOR(s * 100 + 0.5) / 100 AS second_half,
       CASE WHEN f <> 0 THEN FLOOR((s - f) / ABS(f) * 1000.0 + 0.5) / 10.0 END AS growth_pct
FROM s
""")
def a25_half_growth(spark, base):
    o = table(spark, base, "orders")
    g = PD.half_growth(o, "o_orderdate", ["o_totalprice"])
    return g.select("metric", r2("first_half").alias("first_half"), r2("second_half").alias("second_half"),
                    "growth_pct")


# ---------------------------------------------------------------- W3

@register("w03_downsample", f"""
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, SUM(o_totalprice) AS y, COUNT(*) AS n
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY x) - 1 AS idx, COUNT(*) OVER () AS cnt FROM s),
t AS (SELECT *, GREATEST(CAST(CEIL(cnt / 100.0) AS BIGINT), 1) AS step FROM r)
SELECT x, {sql_r('y')} AS y, n, idx FROM t WHERE idx % step = 0 AND idx / step < 100
""")
def w03_downsample(spark, base):
    o = table(spark, base, "orders")
    s = SR.temporal_series(o, "o_orderdate", "o_totalprice", "sum", granularity="day")
    return SR.round_y(SR.downsample(s.drop("granularity"), "x", 100))
