"""Registered queries of the wide pivot, first values, medians, the choice of
an aggregate, filter maps and sorted lists (A17, A19, A30, A31, F1, F2, F14, T2,
T5, P20), each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import profile as PF
from ..operators import series as SR
from ..sources.tables import table
from .catalog_queries import register


@register("a17_wide", """
SELECT COALESCE(NULLIF(TRIM(o_orderpriority), ''), '(Blank)') AS x,
       SUM(CASE WHEN o_orderstatus = 'F' THEN COALESCE(o_totalprice, 0) END) AS "F",
       SUM(CASE WHEN o_orderstatus = 'O' THEN COALESCE(o_totalprice, 0) END) AS "O"
FROM orders GROUP BY 1
""")
def a17_wide(spark, base):
    return SR.series_pivot(table(spark, base, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"])


@register("a19_first_value", "SELECT o_orderpriority AS x, ARG_MIN(o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1")
def a19_first_value(spark, base):
    return SR.first_value(table(spark, base, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


@register("a30_group_median", """
SELECT l_returnflag AS x, QUANTILE_DISC(l_extendedprice, 0.5) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1
""")
def a30_group_median(spark, base):
    return SR.group_aggregate(table(spark, base, "lineitem"), "l_returnflag", "l_extendedprice", "median")


def _other_sql(agg: str) -> str:
    return f"""
WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS x, CAST({agg} AS DOUBLE) AS y, COUNT(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY y DESC NULLS LAST, x ASC NULLS FIRST) AS rank, COUNT(*) OVER () AS groups FROM g)
SELECT x, y, n, rank FROM r WHERE rank < 20 OR groups <= 20
UNION ALL
SELECT 'Other', CAST({agg} AS DOUBLE), COUNT(*), 20 FROM orders
WHERE CAST(o_custkey AS VARCHAR) IN (SELECT x FROM r WHERE rank >= 20 AND groups > 20) HAVING COUNT(*) > 0
"""


@register("t02_top_other_distinct", _other_sql("COUNT(DISTINCT o_orderpriority)"))
def t02_top_other_distinct(spark, base):
    return SR.top_with_other(table(spark, base, "orders"), "o_custkey", "o_orderpriority", "distinct", cap=20)


@register("t02_top_other_median", _other_sql("QUANTILE_DISC(o_totalprice, 0.5)"))
def t02_top_other_median(spark, base):
    return SR.top_with_other(table(spark, base, "orders"), "o_custkey", "o_totalprice", "median", cap=20)


@register("a31_choose_aggregate", """
WITH k AS (
  SELECT o_orderpriority AS kpi, o_orderstatus || '_id' AS "column", 'text' AS type, 'mode' AS explicit FROM orders
  UNION ALL SELECT p_brand, lower(p_type), CASE p_size % 4 WHEN 0 THEN 'currency' WHEN 1 THEN 'percentage' WHEN 2 THEN 'numeric' ELSE 'text' END,
         CASE p_size % 7 WHEN 1 THEN ' Count_Distinct ' WHEN 2 THEN 'MAX' END FROM part
  UNION ALL SELECT c_mktsegment || ' customers', c_name, 'text', NULL FROM customer
  UNION ALL SELECT 'Average ' || r_name, 'n', 'numeric', NULL FROM region
  UNION ALL SELECT r_name, 'usage', 'numeric', 'median' FROM region),
l AS (SELECT *, lower(kpi) || '|' || lower("column") AS names, lower("column") AS c, lower(kpi) AS p, lower(trim(explicit)) AS e FROM k)
SELECT kpi, "column", type, explicit,
  CASE WHEN e IN ('count_distinct', 'distinct') THEN 'distinct' WHEN e IN ('avg', 'sum', 'count', 'min', 'max') THEN e
       WHEN type IN ('numeric', 'currency', 'percentage') THEN
         CASE WHEN regexp_matches(names, 'salary|rating|attendance|margin|ratio|pct|percent|avg|average|score|age') THEN 'avg' ELSE 'sum' END
       WHEN regexp_matches(c, 'id$|id_|_id') OR regexp_matches(p, 'customer|employee|headcount') THEN 'distinct'
       ELSE 'count' END AS aggregation
FROM l
""")
def a31_choose_aggregate(spark, base):
    none, text, number = F.lit(None).cast("string"), F.lit("text"), F.lit("numeric")
    o, p, c, r = (table(spark, base, t) for t in ("orders", "part", "customer", "region"))
    size = F.col("p_size") % 4
    names = ["kpi", "column", "type", "explicit"]
    k = o.select("o_orderpriority", F.concat("o_orderstatus", F.lit("_id")), text, F.lit("mode")).toDF(*names)
    k = k.unionByName(p.select("p_brand", F.lower("p_type"), F.when(size == 0, F.lit("currency")).when(size == 1, F.lit("percentage")).when(size == 2, number).otherwise(text),
                               F.when(F.col("p_size") % 7 == 1, F.lit(" Count_Distinct ")).when(F.col("p_size") % 7 == 2, F.lit("MAX"))).toDF(*names))
    k = k.unionByName(c.select(F.concat("c_mktsegment", F.lit(" customers")), "c_name", text, none).toDF(*names))
    k = k.unionByName(r.select(F.concat(F.lit("Average "), "r_name"), F.lit("n"), number, none).toDF(*names))
    k = k.unionByName(r.select("r_name", F.lit("usage"), number, F.lit("median")).toDF(*names))
    return k.withColumn("aggregation", SR.choose_aggregate("kpi", "column", "type", "explicit"))


@register("f02_filter_map", """
SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 30 DAY
""")
def f02_filter_map(spark, base):
    return FL.combined_filters(table(spark, base, "orders"), {"O_ORDERSTATUS": "O", "date": "30days", "unknown": 1, "o_custkey": ""}, "o_orderdate")


@register("f01_no_such_value", "SELECT * FROM orders WHERE o_custkey = 7")
def f01_no_such_value(spark, base):
    """A value that is none of the column's type matches nothing."""
    o = table(spark, base, "orders")
    return FL.equality_filters(o, {"o_custkey": "7"}).unionByName(FL.equality_filters(o, {"o_custkey": "abc"}))


@register("f14_insight_group", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def f14_insight_group(spark, base):
    """Error events stand for warnings; the group 'alerts' keeps them."""
    e = table(spark, base, "events").select("event_id", "event_type", F.regexp_replace("event_type", "error", "Warning").alias("category"))
    return FL.insight_filter(e, "alerts").drop("category")


@register("t05_sort_uploads", "SELECT o_orderstatus AS name, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, name")
def t05_sort_uploads(spark, base):
    g = table(spark, base, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    return FL.sort_uploads(g, "n", False, "name")


@register("p20_first_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def p20_first_rows(spark, base):
    return PF.first_rows(table(spark, base, "part"), "p_partkey", 5)
