"""Aggregated series: KPI aggregates, group-by charts, time buckets, top-k
with an 'Other' remainder, pivots, histograms, filter options and sequence
steps over aggregated output (A1, A9-A12, A17-A21, A23, A27-A32, T2, W1-W3).

Plans stay declarative: ``groupBy().agg()`` gets Spark's partial+final hash
aggregation (map-side combine, so a hot key is collapsed before the shuffle);
one-value bounds come from scalar subqueries; windows only ever run over
already-aggregated series, whose size is bounded by the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import any_of, clean_number, col_, js_round
from ..session import written
from .periods import _us

#: rank accuracy of the median sketches
MEDIAN_ACCURACY = 10_000
DAY_US = 24 * 60 * 60 * 1_000_000
AGGS = ("sum", "avg", "min", "max", "count")
# Bucket-size thresholds in days (upper bounds, inclusive).
GRANULARITY_THRESHOLDS = [(31, "day"), (180, "week"), (730, "month"), (2000, "quarter")]
# Caps of chart points.
SERVER_POINT_CAP = 100
UI_POINT_CAP = 150
OTHER_LABEL = "Other"
UI_OTHER_LABEL = "Other Categories"
BLANK_LABEL = "(Blank)"
FILTER_OPTION_SALTS = 64


def agg_expr(agg: str, y: str | Column | None) -> Column:
    """Aggregate of ``y`` by name; count (or no y) counts rows."""
    if agg == "count" or y is None or y == "_count":
        return F.count(F.lit(1)).cast("double")
    v = col_(y)
    if agg == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0)).cast("double")
    if agg == "avg":
        return F.avg(v).cast("double")
    if agg == "min":
        return F.min(v).cast("double")
    if agg == "max":
        return F.max(v).cast("double")
    if agg == "median_approx":
        # a sketch: rank error at most 1 / MEDIAN_ACCURACY of the rows
        return F.percentile_approx(v, 0.5, MEDIAN_ACCURACY).cast("double")
    if agg == "median":
        raise ValueError("the exact median is a plan, not an aggregate: see group_medians")
    if agg == "count_values":
        return F.count(v).cast("double")
    if agg in ("distinct", "count_distinct"):
        return F.count_distinct(v).cast("double")
    raise ValueError(f"unknown aggregate {agg!r}")


def group_medians(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Exact lower and upper middle value of ``y`` per group, at any size:
    (keys, lower, upper).

    A sketch brackets the middle; equal values are counted once (map-side
    combined), those below the bracket are summed, and only the distinct
    values inside it are ranked."""
    vals = df.select(*keys, F.col(y).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    near = [0.5 - 2 / MEDIAN_ACCURACY, 0.5 + 2 / MEDIAN_ACCURACY]
    bracket = vals.groupBy(*keys).agg(F.percentile_approx("_v", near, MEDIAN_ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_total"))
    bracket = bracket.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b", "_total")
    counts = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if keys:
        c = counts.join(bracket, on)
    else:  # one group: its bracket is one row
        b = bracket.select(F.struct("_b", "_total")).scalar()
        c = counts.withColumn("_b", b.getField("_b")).withColumn("_total", b.getField("_total"))
    # everything below the bracket becomes one row at its lower end's left
    left = F.when(F.col("_v") < F.col("_b")[0], F.lit(float("-inf"))).otherwise(F.col("_v"))
    c = c.filter(F.col("_v") <= F.col("_b")[1]).groupBy(*keys, left.alias("_v")).agg(F.sum("_n").alias("_n"), F.first("_total").alias("_total"))
    run = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    r = c.withColumn("_run", run).filter(F.col("_run") >= F.ceil(F.col("_total") / 2))
    first = F.min("_v").alias("lower")
    upper = F.min(F.when(F.col("_run") >= F.floor(F.col("_total") / 2) + 1, F.col("_v"))).alias("upper")
    return r.groupBy(*keys).agg(first, upper)


def _joined_median(grouped: DataFrame, df: DataFrame, x: str, y: str) -> DataFrame:
    """``grouped`` (x, ...) with the exact lower median of y as column y."""
    m = group_medians(df, [x], y).select(F.col(x).alias("_mx"), F.col("lower").alias("y"))
    return grouped.join(m, F.col("x").eqNullSafe(F.col("_mx")), "left").drop("_mx")


# ----------------------------------------------------------------- A1 / A27

def kpi_aggregates(df: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Many aggregates in one pass -> one row.

    ``specs`` are (output name, column, aggregate); a median is a scalar of
    its own plan."""
    rest = [agg_expr(a, c).alias(n) for n, c, a in specs if a != "median"]
    out = df.agg(*(rest or [F.count(F.lit(1)).alias("_rows")]))
    for n, c, a in specs:
        if a == "median":
            out = out.withColumn(n, group_medians(df, [], c).select("lower").scalar())
    return out.select(*[n for n, _, _ in specs])


def ui_kpi(df: DataFrame, column: str, agg: str) -> DataFrame:
    """Count / sum / avg with everything but ``0-9 . -`` stripped
    (bad cells count as 0, avg over all rows)."""
    from ..functions.predicates import digits_only_number
    v = digits_only_number(column)
    if agg == "count":
        e = F.count(F.lit(1)).cast("double")
    elif agg == "avg":
        e = F.coalesce(F.avg(v), F.lit(0.0))
    else:
        e = F.coalesce(F.sum(v), F.lit(0.0))
    return df.agg(e.alias("value"))


def ui_kpis(df: DataFrame, column: str) -> DataFrame:
    """A28 for all three aggregates in one pass: (sum_value, avg_value, count_value)."""
    from ..functions.predicates import digits_only_number
    v = digits_only_number(column)
    return df.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("sum_value"),
                  F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_value"),
                  F.count(F.lit(1)).cast("double").alias("count_value"))


# ----------------------------------------------------------------- A9 / A12

def group_aggregate(df: DataFrame, x: str, y: str | None, agg: str = "sum",
                    x_alias: str = "x") -> DataFrame:
    """Group by a category -> (x, y, n), sorted by y desc then x.

    The null key is its own group, as in the reference."""
    if agg == "median":
        g = df.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        return _joined_median(g, df, x, y).select(F.col("x").alias(x_alias), "y", "n").orderBy(F.desc("y"), F.asc(x_alias))
    return (df.groupBy(F.col(x).alias(x_alias))
            .agg(agg_expr(agg, y).alias("y"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("y"), F.asc(x_alias)))


def naive_date_group(df: DataFrame, date_col: str, y: str | None, agg: str = "sum") -> DataFrame:
    """Group by the exact date value (legacy fallback), sorted by x."""
    return (df.filter(F.col(date_col).isNotNull())
            .groupBy(F.col(date_col).cast("string").alias("x"))
            .agg(agg_expr(agg, y).alias("y"), F.count(F.lit(1)).alias("n"))
            .orderBy("x"))


# ----------------------------------------------------------------- A10 / A11

def bucket_label(ts: Column, granularity: str) -> Column:
    """A10 bucket labels: day ``yyyy-MM-dd``, ISO week ``YYYY-Www``,
    month ``yyyy-MM``, quarter ``yyyy-Qn``, year ``yyyy``."""
    if granularity == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if granularity == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if granularity == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    if granularity == "year":
        return F.date_format(ts, "yyyy")
    return F.date_format(ts, "yyyy-MM")


def choose_granularity(min_date: Column, max_date: Column) -> Column:
    """Span in days -> day/week/month/quarter/year; unknown -> month."""
    days = (_us(max_date) - _us(min_date)) / F.lit(float(DAY_US))
    g = F.when(min_date.isNull() | max_date.isNull(), F.lit("month"))
    for limit, name in GRANULARITY_THRESHOLDS:
        g = g.when(days <= limit, F.lit(name))
    return g.otherwise(F.lit("year"))


def bucket_by(ts: Column, granularity: Column) -> Column:
    """Label for a granularity given as a Column (e.g. chosen from data)."""
    out = None
    for g in ("day", "week", "month", "quarter", "year"):
        out = (F.when(granularity == g, bucket_label(ts, g)) if out is None
               else out.when(granularity == g, bucket_label(ts, g)))
    return out


def bucket_start(ts: Column, granularity: Column) -> Column:
    """First instant of the bucket, for a granularity given as a Column."""
    out = None
    for g in ("day", "week", "month", "quarter", "year"):
        out = F.when(granularity == g, F.date_trunc(g, ts)) if out is None else out.when(granularity == g, F.date_trunc(g, ts))
    return out


def temporal_series(df: DataFrame, date_col: str, y: str | None = None, agg: str = "sum",
                    granularity: str | None = None) -> DataFrame:
    """A10 + A11: time-bucketed aggregation -> (x, y, n, granularity).

    Without an explicit granularity it is chosen from the date span, which
    Spark computes once as a scalar subquery.  Null dates and null buckets
    are dropped; rows sorted by label (chronological for every label form).
    """
    d = F.col(date_col)
    g = granularity_scalar(df, date_col) if granularity is None else F.lit(granularity)
    # rows are grouped by the start of their bucket; only the few groups get labels
    start = bucket_start(d, g) if granularity is None else F.date_trunc(granularity, d)
    d = F.col("_start")
    label = bucket_by(d, g) if granularity is None else bucket_label(d, granularity)
    return (df.filter(F.col(date_col).isNotNull())
            .groupBy(start.alias("_start"))
            .agg(agg_expr(agg, y).alias("y"), F.count(F.lit(1)).alias("n"))
            .select(label.alias("x"), "y", "n", g.alias("granularity"))
            .orderBy("x"))


def granularity_scalar(df: DataFrame, date_col: str) -> Column:
    """A11 evaluated once, as a scalar subquery yielding the granularity name."""
    b = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    return b.select(choose_granularity(F.col("lo"), F.col("hi"))).scalar()


# ----------------------------------------------------------------- T2

def top_with_other(df: DataFrame, x: str, y: str | None, agg: str = "sum",
                   cap: int = SERVER_POINT_CAP, other_label: str = OTHER_LABEL) -> DataFrame:
    """Groups by ``x``; if there are more than ``cap`` groups, keep the
    top ``cap - 1`` by y (ties by x) and fold the rest into one 'Other' row.

    The rest is re-combined from per-group sum/count/min/max, so averages
    of 'Other' are true averages.  The top list is a TakeOrderedAndProject
    (bounded by ``cap`` per partition); the remainder is found with a
    broadcast anti join against that bounded list (null-safe key) and
    folded by a partial+final aggregate.  Output: (x, y, n, rank).
    """
    v = None if (agg == "count" or y is None or y == "_count") else F.col(y)
    df = df.withColumn("_x", F.col(x).cast("string"))
    value = F.lit(None).cast("double") if agg == "median" else agg_expr(agg, y)
    g = df.groupBy(F.col("_x").alias("x")).agg(
        value.alias("y"), F.count(F.lit(1)).alias("n"),
        (F.sum(v) if v is not None else F.count(F.lit(1))).cast("double").alias("s"),
        (F.count(v) if v is not None else F.count(F.lit(1))).alias("c"),
        (F.min(v) if v is not None else F.lit(None)).cast("double").alias("mn"),
        (F.max(v) if v is not None else F.lit(None)).cast("double").alias("mx"))
    if agg == "median":
        g = _joined_median(g.drop("y"), df, "_x", y)
    n_groups = g.select(F.count(F.lit(1))).scalar()
    order = [F.desc_nulls_last("y"), F.asc_nulls_first("x")]
    top = g.orderBy(*order).limit(cap)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    keep = top.filter((F.col("rank") < cap) | (n_groups <= cap))
    head = top.filter(F.col("rank") < cap).select(F.col("x").alias("tx"))
    rest = g.join(F.broadcast(head), g["x"].eqNullSafe(head["tx"]), "left_anti")
    folded = rest.agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("mn").alias("mn"),
                      F.max("mx").alias("mx"), F.sum("n").alias("n"),
                      F.sum("y").alias("ysum"))
    if agg == "avg":
        oy = F.col("s") / F.col("c")
    elif agg == "min":
        oy = F.col("mn")
    elif agg == "max":
        oy = F.col("mx")
    elif agg == "count" or v is None:
        oy = F.col("n").cast("double")
    elif agg != "sum":
        # neither follows from the groups: computed from the rest's own rows
        rows = df.join(F.broadcast(head), df["_x"].eqNullSafe(head["tx"]), "left_anti")
        oy = (group_medians(rows, [], y).select("lower") if agg == "median" else rows.agg(agg_expr(agg, y).alias("v"))).scalar()
    else:
        oy = F.coalesce(F.col("s"), F.lit(0.0))
    other = folded.filter(n_groups > cap).select(
        F.lit(other_label).alias("x"), oy.cast("double").alias("y"),
        F.col("n").cast("long").alias("n"), F.lit(cap).cast("long").alias("rank"))
    return keep.select("x", "y", "n", "rank").unionByName(other)


# ----------------------------------------------------------------- A17 / A18 / A19

def blank_key(c, label: str = BLANK_LABEL) -> Column:
    """null/blank keys -> a label."""
    s = F.nullif(F.trim(col_(c).cast("string")), F.lit(""))
    return F.coalesce(s, F.lit(label))


def series_long(df: DataFrame, x: str, series: str, y: str | None, agg: str = "sum") -> DataFrame:
    """A17 + A18 in long form: (x, series, y, n) per x and series key.

    Values are cleaned as the UI does (``$ , %`` and spaces stripped; bad
    cells are 0).  Long form keeps the series count unbounded; ``pivot``
    below needs an explicit, bounded value list."""
    val = F.lit(1.0) if (y is None or y == "_count") else clean_number(y, bad_as_zero=True)
    val = F.when(F.col(y).isNull(), F.lit(0.0)).otherwise(val) if y not in (None, "_count") else val
    if agg == "count":
        e = F.count(F.lit(1)).cast("double")
    elif agg == "avg":
        e = F.avg(val)
    else:
        e = F.sum(val)
    return (df.groupBy(blank_key(x).alias("x"), blank_key(series, OTHER_LABEL).alias("series"))
            .agg(e.cast("double").alias("y"), F.count(F.lit(1)).alias("n")))


def series_pivot(df: DataFrame, x: str, series: str, y: str | None, values: list[str],
                 agg: str = "sum") -> DataFrame:
    """A17 wide: one column per listed series value (explicit list, so no
    driver-side distinct collection)."""
    long = series_long(df, x, series, y, agg)
    return long.groupBy("x").pivot("series", values).agg(F.first("y"))


def fold_series(groups: DataFrame, by: list[str], cap: int | Column, keep: list[str], total: str = "s") -> DataFrame:
    """A17, the heavy hitters: of partial aggregates (by, keep, series, n, c, s,
    lo, hi) the ``cap`` series with the largest total per ``by`` keep their
    names, ties by name; all others become one series 'Other', whose sums, counts
    and extremes are joined.  Adds series_rank: 1, 2, ... and cap + 1 for the
    rest.  Series that are called 'Other' (blank ones among them) belong to it.

    Two phases: totals per series (small against the rows) and their first
    ``cap`` per dataset, a list of at most cap rows that is broadcast; then the
    groups are folded by it."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    totals = groups.filter(F.col("series") != OTHER_LABEL).groupBy(*by, "series", cap.alias("_cap")).agg(F.sum(total).alias("_t"))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_t"), "series")
    head = totals.withColumn("series_rank", F.row_number().over(w)).filter(F.col("series_rank") <= F.col("_cap"))
    on = F.col("series") == F.col("_series")
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    head = head.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("series").alias("_series"), "series_rank")
    g = groups.withColumn("_cap", cap).join(F.broadcast(head), on, "left")
    named = F.col("series_rank").isNotNull()
    g = g.withColumn("series", F.when(named, F.col("series")).otherwise(F.lit(OTHER_LABEL)))
    g = g.withColumn("series_rank", F.when(named, F.col("series_rank")).otherwise(F.col("_cap") + 1).cast("int"))
    return g.groupBy(*keep, "series_rank", "series").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"),
                                                         F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def top_series(df: DataFrame, x: str, series: str, y: str | None, agg: str = "sum", cap: int = 5) -> DataFrame:
    """A17 with series found from the data: one row per x; y and n over all its
    rows; for each rank k = 1 .. cap the columns label_k (the series, the same in
    every row; null if there are fewer), y_k and n_k, and y_other, n_other of all
    other series (null where x has no such rows).

    Series are ranked by the sum of their values (for counts by rows), ties by
    name.  Columns are ranks, so the plan does not depend on the data; labels are
    values.  Values are cleaned as in ``series_long``.  The rows are scanned
    once: the groups (x, series) are written and both phases read them."""
    if agg not in ("sum", "avg", "count"):
        raise ValueError(f"unknown aggregate {agg!r}")
    if y in (None, "_count"):
        v = F.lit(1.0)
    else:
        v = F.when(F.col(y).isNull(), F.lit(0.0)).otherwise(clean_number(y, bad_as_zero=True))
    g = df.groupBy(blank_key(x).alias("x"), blank_key(series, OTHER_LABEL).alias("series")).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("c"), F.sum(v).cast("double").alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    g = written(g, "series-groups")
    folded = fold_series(g, [], cap, ["x"], "n" if agg == "count" else "s")
    value = {"sum": F.col("s"), "avg": F.col("s") / F.col("c"), "count": F.col("n").cast("double")}[agg]
    folded = folded.select("x", "series_rank", "series", "n", "c", "s", value.alias("y"))
    labels = folded.select(F.struct(*[F.max(F.when(F.col("series_rank") == k, F.col("series"))).alias(f"l{k}") for k in range(1, cap + 1)])).scalar()
    whole = {"sum": F.sum("s"), "avg": F.sum("s") / F.sum("c"), "count": F.sum("n").cast("double")}[agg]
    at = lambda c, k: F.max(F.when(F.col("series_rank") == k, F.col(c)))
    ranks = [a for k in range(1, cap + 1) for a in (at("y", k).alias(f"y_{k}"), at("n", k).alias(f"n_{k}"))]
    out = folded.groupBy("x").agg(whole.alias("y"), F.sum("n").alias("n"), *ranks, at("y", cap + 1).alias("y_other"), at("n", cap + 1).alias("n_other"))
    cols = [c for k in range(1, cap + 1) for c in (labels.getField(f"l{k}").alias(f"label_{k}"), F.col(f"y_{k}"), F.col(f"n_{k}"))]
    return out.select("x", "y", "n", *cols, "y_other", "n_other")


def first_value(df: DataFrame, x: str, y: str, order_key: str) -> DataFrame:
    """The 'first' y per x, made deterministic by an order key."""
    return df.groupBy(F.col(x).alias("x")).agg(F.min_by(F.col(y), F.col(order_key)).alias("y"))


# ----------------------------------------------------------------- A31

# Words of KPI or column names that call for an average, and of
# KPI names that call for a distinct count.
AVERAGE_WORDS = ["salary", "rating", "attendance", "margin", "ratio", "pct", "percent", "avg", "average", "score", "age"]
DISTINCT_KPI_WORDS = ["customer", "employee", "headcount"]
NUMBER_TYPES = ["numeric", "currency", "percentage"]
EXPLICIT_AGGREGATES = ["avg", "sum", "count", "min", "max"]


def choose_aggregate(kpi, column, column_type, explicit) -> Column:
    """An explicit aggregate wins (count_distinct and distinct are one);
    else numbers are averaged if a name says so and summed if not; ids and
    people are counted distinct; anything else is counted."""
    k, c = F.lower(F.coalesce(col_(kpi), F.lit(""))), F.lower(F.coalesce(col_(column), F.lit("")))
    e = F.lower(F.trim(col_(explicit)))
    rate = any_of([x.contains(w) for w in AVERAGE_WORDS for x in (k, c)])
    ident = c.endswith("id") | c.contains("id_") | c.contains("_id") | any_of([k.contains(w) for w in DISTINCT_KPI_WORDS])
    return (F.when(e.isin("count_distinct", "distinct"), F.lit("distinct")).when(e.isin(EXPLICIT_AGGREGATES), e)
            .when(col_(column_type).isin(NUMBER_TYPES), F.when(rate, F.lit("avg")).otherwise(F.lit("sum")))
            .when(ident, F.lit("distinct")).otherwise(F.lit("count")))


# ----------------------------------------------------------------- A20

def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between min and max; the max lands in the last
    bin; zero width -> width 1.  Every bin is returned, empty ones with 0.
    Output (bin, x label, bin_start, bin_end, y)."""
    v = clean_number(column)
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    w0 = (F.max("v") - F.min("v")) / F.lit(float(bins))
    b = vals.select(F.struct(F.min("v").alias("lo"),
                             F.when(w0 == 0, F.lit(1.0)).otherwise(w0).alias("w"))).scalar()
    lo, width = b.getField("lo"), b.getField("w")
    idx = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("y"))
    # the bin list is a fixed-size range, joined to the (<= bins) counts
    allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = allb.join(counts, "bin", "left").filter(lo.isNotNull())
    start = lo + F.col("bin") * width
    end = start + width
    lbl = F.concat(F.floor(start + F.lit(0.5)).cast("string"), F.lit("-"),
                   F.floor(end + F.lit(0.5)).cast("string"))
    return out.select("bin", lbl.alias("x"), start.alias("bin_start"), end.alias("bin_end"),
                      F.coalesce(F.col("y"), F.lit(0)).cast("long").alias("y"))


# ----------------------------------------------------------------- A21

def filter_options(df: DataFrame, columns: list[str], limit: int = 25,
                   sort_values: bool = True) -> DataFrame:
    """Distinct non-empty values per column, at most ``limit`` each.

    Unpivot to (column, value), ``distinct`` (map-side deduplicated), then a
    window partitioned by column keeps the first ``limit`` values in value
    order.  Output (column, value, rank)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("e")).select("e.column", "e.value")
    long = long.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    d = long.distinct()
    # a column may have very many distinct values: rank within hash salts
    # first (each salt holds 1/SALTS of them, in its own task), then rank
    # the at most limit * SALTS survivors of each column
    salt = F.pmod(F.xxhash64("value"), F.lit(FILTER_OPTION_SALTS))
    w1 = Window.partitionBy("column", salt).orderBy("value")
    pre = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= limit).drop("_r")
    w = Window.partitionBy("column").orderBy("value")
    return pre.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


# ----------------------------------------------------------------- A23

def category_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Value counts of a category column, with the top value (most
    rows, ties by smallest value) flagged.  Output (value, n, is_top)."""
    g = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = g.select(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))).scalar()
    return g.withColumn("is_top", F.col("value").eqNullSafe(best.getField("v")))


# ----------------------------------------------------------------- A30 / A32

def percentage_distribution(grouped: DataFrame, y: str = "y") -> DataFrame:
    """Share of each group in the total (over aggregated output)."""
    total = grouped.select(F.sum(y)).scalar()
    return grouped.withColumn("pct", F.col(y) / total * F.lit(100.0))


def share_of_max(grouped: DataFrame, y: str = "y", first: int = 10) -> DataFrame:
    """Y as % of the largest y, first ``first`` rows in y order."""
    mx = grouped.select(F.max(y)).scalar()
    return grouped.orderBy(F.desc(y), F.asc(grouped.columns[0])).limit(first).withColumn(
        "share", F.when(mx != 0, F.col(y) / mx * F.lit(100.0)).otherwise(F.lit(0.0)))


# ----------------------------------------------------------------- W1 / W2 / W3

def previous_change(series: DataFrame, x: str = "x", y: str = "y",
                    partition: list[str] | None = None) -> DataFrame:
    """% change to the previous point of an aggregated series."""
    w = Window.partitionBy(*(partition or [])).orderBy(x)
    prev = F.lag(y).over(w)
    return series.withColumn("prev_y", prev).withColumn(
        "change_pct", F.when(F.col("prev_y") != 0, (F.col(y) - F.col("prev_y")) / F.abs(F.col("prev_y"))
                             * F.lit(100.0)))


def series_index(series: DataFrame, x: str = "x", partition: list[str] | None = None) -> DataFrame:
    """Zero-based position in an aggregated series."""
    w = Window.partitionBy(*(partition or [])).orderBy(x)
    return series.withColumn("idx", F.row_number().over(w) - 1)


def downsample(series: DataFrame, x: str = "x", cap: int = SERVER_POINT_CAP,
               partition: list[str] | None = None) -> DataFrame:
    """Keep every ceil(n/cap)-th point of an aggregated series, at most
    ``cap`` points."""
    part = partition or []
    w = Window.partitionBy(*part).orderBy(x)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    step = F.greatest(F.ceil(n / F.lit(float(cap))), F.lit(1))
    out = series.withColumn("_rn", (F.row_number().over(w) - 1).cast("long")).withColumn("_step", step)
    out = out.filter((F.col("_rn") % F.col("_step")) == 0)
    return out.filter(F.col("_rn") / F.col("_step") < cap).drop("_step").withColumnRenamed("_rn", "idx")


def round_y(df: DataFrame, digits: int = 2, cols=("y",)) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, js_round(c, digits))
    return df
