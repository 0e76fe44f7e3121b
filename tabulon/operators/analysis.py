"""The fixed analysis operations (A13-A16): group_by, compare_periods,
filter_and_aggregate and top_n.

The reference runs these as loops over all rows pulled into one process.
Here each is a single DataFrame plan: one ``groupBy`` (partial aggregation
before the shuffle), a window only over the aggregated periods, and an
ordered ``limit`` (TakeOrderedAndProject) for top-n.  Output columns are
named after the resolved group and metric columns, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import floor_double, js_round, parse_float
from .filters import clamp_limit, kind_of, resolve_column

AGGREGATIONS = ("sum", "avg", "min", "max", "count")


def _first_column(df: DataFrame) -> str:
    return df.columns[0]


def _number(df: DataFrame, column: str | None) -> Column:
    """``parseFloat`` of a cell; typed numeric columns are used directly."""
    if column is None:
        return F.lit(None).cast("double")
    dt = df.schema[column].dataType
    if kind_of(dt) == "number":
        return F.col(column).cast("double")
    return parse_float(column)


def _key(df: DataFrame, column: str, null_label: str) -> Column:
    c = F.col(column)
    if kind_of(df.schema[column].dataType) == "date":
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(c.cast("string"), F.lit(null_label))


def group_by(df: DataFrame, group: str | None = None, metric: str | None = None,
             aggregation: str = "sum") -> DataFrame:
    """Group (null -> 'Unknown'); aggregate parseable metric values;
    a group without numbers (or ``count``) yields its row count; 2 dp;
    sorted by value desc (ties by key)."""
    g = resolve_column(df, group, ("string", "boolean", "date")) or _first_column(df)
    m = resolve_column(df, metric, ("number",)) or resolve_column(df, None, fallback_first_of="number")
    agg = aggregation if aggregation in AGGREGATIONS else "sum"
    v = _number(df, m)
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(agg)
    n_vals = F.count(v)
    val = F.count(F.lit(1)).cast("double") if fn is None else \
        F.when(n_vals == 0, F.count(F.lit(1)).cast("double")).otherwise(fn(v).cast("double"))
    out_name = m or "Count"
    res = df.groupBy(_key(df, g, "Unknown").alias(g)).agg(js_round(val, 2).alias(out_name))
    return res.orderBy(F.desc(out_name), F.asc(g))


def period_key(ts: Column, period: str = "monthly") -> Column:
    if period == "yearly":
        return F.date_format(ts, "yyyy")
    if period == "quarterly":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def compare_periods(df: DataFrame, metric: str | None = None, date_column: str | None = None,
                    period: str = "monthly") -> DataFrame:
    """A14 (+ W1): per-period sum of the metric (bad/null as 0) and the
    integer % change to the previous present period (0 when the previous
    sum is <= 0).  Periods are monthly by default; quarterly / yearly are
    honoured.  Output (Period, <metric>, change_pct, n)."""
    d = resolve_column(df, date_column, ("date",)) or resolve_column(df, None, fallback_first_of="date") \
        or _first_column(df)
    m = resolve_column(df, metric, ("number",)) or resolve_column(df, None, fallback_first_of="number")
    out_name = m or "Value"
    ts = F.col(d) if kind_of(df.schema[d].dataType) == "date" else F.try_to_timestamp(F.col(d).cast("string"))
    v = F.coalesce(_number(df, m), F.lit(0.0))
    per = (df.filter(ts.isNotNull())
           .groupBy(period_key(ts, period).alias("Period"))
           .agg(F.sum(v).alias("_sum"), F.count(F.lit(1)).alias("n")))
    # the window runs over the aggregated periods only (bounded by their count)
    prev = F.lag("_sum").over(Window.orderBy("Period"))
    val = js_round(F.col("_sum"), 2)
    change = F.when(prev > 0, floor_double((val - prev) / prev * F.lit(100.0) + F.lit(0.5))).otherwise(F.lit(0.0))
    return per.select("Period", val.alias(out_name), change.alias("change_pct"), "n") \
        .orderBy("Period")


def filter_and_aggregate(df: DataFrame, filter_column: str | None = None, filter_value=None,
                         metric: str | None = None, aggregation: str = "sum",
                         group: str | None = None, fallback_all: bool = False) -> DataFrame:
    """Case-insensitive 'contains' filter, then group (null ->
    'Filtered Group') and aggregate the metric with bad/null values as 0.
    No match gives an empty result unless ``fallback_all`` (reference
    behaviour: all rows)."""
    fc = resolve_column(df, filter_column) or _first_column(df)
    m = resolve_column(df, metric, ("number",)) or resolve_column(df, None, fallback_first_of="number")
    agg = aggregation if aggregation in AGGREGATIONS else "sum"
    g = resolve_column(df, group, ("string", "boolean")) or fc
    from .filters import contains_filter
    rows = contains_filter(df, fc, None if filter_value is None else str(filter_value), fallback_all)
    v = F.coalesce(_number(df, m), F.lit(0.0))
    e = {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v),
         "count": F.count(F.lit(1)).cast("double")}[agg]
    out_name = m or "Value"
    return rows.groupBy(_key(df, g, "Filtered Group").alias(g)).agg(js_round(e, 2).alias(out_name))


def top_n(df: DataFrame, group: str | None = None, metric: str | None = None, limit=5,
          direction: str = "desc") -> DataFrame:
    """Sum of the metric (bad/null as 0) per group (null -> 'Unknown'),
    2 dp, ``limit`` clamped to 1-20 (default 5), asc or desc; ties by key.
    Runs as partial aggregation + TakeOrderedAndProject."""
    g = resolve_column(df, group, ("string", "boolean", "date")) or _first_column(df)
    m = resolve_column(df, metric, ("number",)) or resolve_column(df, None, fallback_first_of="number")
    n = clamp_limit(limit)
    v = F.coalesce(_number(df, m), F.lit(0.0))
    out_name = m or "Value"
    res = df.groupBy(_key(df, g, "Unknown").alias(g)).agg(js_round(F.sum(v), 2).alias(out_name))
    o = F.asc(out_name) if direction == "asc" else F.desc(out_name)
    return res.orderBy(o, F.asc(g)).limit(n)


def execute(df: DataFrame, operation: dict) -> DataFrame:
    """Run one operation spec ``{action, metric, groupBy, ...}``; unknown
    actions fall back to group_by."""
    op = dict(operation or {})
    action = op.get("action") or "group_by"
    if action == "compare_periods":
        return compare_periods(df, op.get("metric"), op.get("dateColumn"), op.get("periodType") or "monthly")
    if action == "filter_and_aggregate":
        return filter_and_aggregate(df, op.get("filterColumn"), op.get("filterValue"), op.get("metric"),
                                    op.get("aggregation") or "sum", op.get("groupBy"),
                                    bool(op.get("fallbackAll", False)))
    if action == "top_n":
        return top_n(df, op.get("groupBy"), op.get("metric"), op.get("limit", 5), op.get("direction", "desc"))
    return group_by(df, op.get("groupBy"), op.get("metric"), op.get("aggregation") or "sum")
