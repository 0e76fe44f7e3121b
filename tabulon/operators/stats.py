"""Statistics and result checks.

G1 is one aggregate over all pairs of columns (its size is the square of the
number of columns, never of rows).  G2-G5 and A26 work
on aggregated series, whose size is bounded by the number of buckets, so a
global aggregate or window over them is cheap.  A24 is one pass over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import floor_double, js_round
from .series import group_medians

# Thresholds of the result checks and outlier rules.
MIN_CHART_POINTS = 2
ZERO_VARIANCE_CV = 0.001
PIE_DOMINANCE = 0.95
Z_OUTLIER = 1.8
SIGMA_OUTLIER = 2.0
FORECAST_STEPS = 7
SHARE_NOTABLE_PCT = 30.0


#: columns up to which all pairs are aggregates of their own
PAIRWISE_COLUMNS = 24


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """G1: Pearson correlation of every pair of numeric columns over all
    rows; nulls count as 0; zero variance gives 0.  Long form
    (variable, other, correlation), both orders and the diagonal.

    One lazy aggregate of covariances and deviations, each updated around its
    running mean, for up to PAIRWISE_COLUMNS columns; wider tables sum outer
    products in one pass."""
    vals = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    if len(columns) > PAIRWISE_COLUMNS:
        return _wide_correlation(df, vals, columns, digits)
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    # rounding gives a constant column a deviation of some 1e-16; its extremes tell
    spread = lambda i: F.when(F.min(f"c{i}") < F.max(f"c{i}"), F.stddev_pop(f"c{i}"))
    row = vals.agg(*[F.coalesce(spread(i), F.lit(0.0)).alias(f"s{i}") for i in range(n)], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs])

    def r(i: int, j: int):
        spread = F.col(f"s{i}") * F.col(f"s{j}")
        if i == j:
            return F.when(F.col(f"s{i}") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.coalesce(F.col(f"v{min(i, j)}_{max(i, j)}") / F.nullif(spread, F.lit(0.0)), F.lit(0.0))

    out = F.array(*[F.struct(F.lit(a).alias("variable"), F.lit(b).alias("other"), js_round(r(i, j), digits).alias("correlation"))
                    for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return row.select(F.inline(out))


def _wide_correlation(df: DataFrame, vals: DataFrame, columns: list[str], digits: int) -> DataFrame:
    # one mergeable sum of outer products, whatever the number of columns
    vector = VectorAssembler(inputCols=vals.columns, outputCol="v", handleInvalid="keep").transform(vals).select("v")
    row = Correlation.corr(vector, "v").first() if not df.isEmpty() else None
    r = row[0].toArray() if row else np.zeros((len(columns), len(columns)))  # columns^2 numbers
    r = np.where(np.isnan(r), 0.0, r)
    flat = ~np.any(np.abs(r - np.eye(len(columns))) > 0, axis=1)
    out = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    constant = [c for c, lone in zip(columns, flat) if lone]
    out = df.sparkSession.createDataFrame(out, "variable string, other string, correlation double")
    if constant:  # a column without variance correlates with nothing, itself included
        spread = vals.agg(*[F.coalesce(F.stddev_pop(f"c{columns.index(c)}"), F.lit(0.0)).alias(c) for c in constant]).first()
        dead = [c for c in constant if not spread[c]]
        out = out.withColumn("correlation", F.when(F.col("variable").isin(dead) | F.col("other").isin(dead), F.lit(0.0)).otherwise(F.col("correlation")))
    return out.withColumn("correlation", js_round("correlation", digits))


def forecast(series: DataFrame, x: str = "x", y: str = "y", steps: int = FORECAST_STEPS,
             partition: list[str] | None = None) -> DataFrame:
    """G2 (+ W2): least-squares line over the point index of an aggregated
    series, ``steps`` points ahead, clamped at 0 and rounded; needs >= 2
    points; a constant index gives slope 0.  Output (step, x, y)."""
    part = partition or []
    w = Window.partitionBy(*part).orderBy(x)
    pts = series.select(*part, (F.row_number().over(w) - 1).cast("double").alias("i"),
                        F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("v"))
    fit = pts.groupBy(*part).agg(F.count(F.lit(1)).alias("n"),
                                 F.coalesce(F.regr_slope("v", "i"), F.lit(0.0)).alias("slope"),
                                 F.sum("i").alias("sx"), F.sum("v").alias("sy"))
    fit = fit.filter(F.col("n") >= 2).withColumn(
        "intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    out = fit.select(*part, "n", "slope", "intercept",
                     F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    nxt = F.col("n") - 1 + F.col("step")
    pred = F.greatest(F.col("slope") * nxt + F.col("intercept"), F.lit(0.0))
    return out.select(*part, F.col("step").cast("long").alias("step"), F.concat(F.lit("Forecast +"), F.col("step").cast("string")).alias("x"),
                      floor_double(pred + F.lit(0.5)).alias("y"))


def _moments(s: DataFrame, v: str) -> Column:
    """struct(mean, sd, cnt) of a column, as a scalar of one aggregate."""
    return s.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(F.lit(1)).alias("cnt")).select(F.struct("mean", "sd", "cnt")).scalar()


def zscore_outliers(series: DataFrame, x: str = "x", y: str = "y", limit: float = Z_OUTLIER) -> DataFrame:
    """Points with |z| > limit, population sd (0 -> 1), needs >= 3
    points.  Output (idx, x, y, z, side)."""
    v = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    s = series.select(F.col(x).alias("x"), F.col(y).alias("y"), v.alias("v"))
    m = _moments(s, "v")
    s = s.withColumn("idx", (F.row_number().over(Window.orderBy("x")) - 1).cast("long"))
    s = s.select("*", m.getField("mean").alias("mean"), m.getField("sd").alias("sd"), m.getField("cnt").alias("cnt"))
    sd = F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd"))
    z = (F.col("y") - F.col("mean")) / sd
    out = s.withColumn("z", z).filter((F.col("cnt") >= 3) & (F.abs(F.col("z")) > limit))
    return out.select("idx", "x", "y", js_round("z", 2).alias("z"),
                      F.when(F.col("y") > F.col("mean"), F.lit("High")).otherwise(F.lit("Low")).alias("side"))


def sigma_outliers(series: DataFrame, x: str = "x", y: str = "y", k: float = SIGMA_OUTLIER) -> DataFrame:
    """Points more than k population sd from the mean; needs > 2
    points and sd > 0.  Output (x, y)."""
    s = series.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("y").isNotNull())
    m = _moments(s, "y")
    s = s.select("*", m.getField("mean").alias("mean"), m.getField("sd").alias("sd"), m.getField("cnt").alias("cnt"))
    return s.filter((F.col("cnt") > 2) & (F.col("sd") > 0) &
                    (F.abs(F.col("y") - F.col("mean")) > F.lit(k) * F.col("sd"))).select("x", "y")


def chart_checks(points: DataFrame, chart_col: str = "chart_id", y: str = "y",
                 type_col: str | None = "chart_type", charts: DataFrame | None = None) -> DataFrame:
    """Per chart: empty, < 2 points, all y invalid, coefficient of
    variation < 0.001 (invalid); pie with one slice > 95 % (warning).
    ``charts`` lists all charts (chart_id, chart_type), so that one without
    points is reported as empty.  Output (chart_id, valid, reason, warning)."""
    yv = F.col(y).cast("double")
    ok = F.when(yv.isNotNull() & ~F.isnan(yv) & (F.abs(yv) < F.lit(float("inf"))), yv)
    ctype = F.min(F.col(type_col)) if type_col else F.lit("")
    g = points.groupBy(chart_col).agg(
        F.count(F.lit(1)).alias("n"), F.count(ok).alias("nv"), F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("sd"), F.sum(F.abs(ok)).alias("tot"), F.max(F.abs(ok)).alias("mx"),
        ctype.alias("ctype"))
    if charts is not None:
        g = charts.select(chart_col, F.col(type_col).alias("ctype")).join(g.drop("ctype"), chart_col, "left").fillna(0, ["n", "nv"])
    mean, sd = F.col("mean"), F.col("sd")
    flat = (F.col("nv") >= 2) & (F.abs(mean) > F.lit(1e-10)) & (sd / F.abs(mean) < F.lit(ZERO_VARIANCE_CV))
    reason = (F.when(F.col("n") == 0, F.lit("Aggregation returned no data"))
              .when(F.col("n") < MIN_CHART_POINTS,
                    F.format_string("Only %d data point(s) — chart requires at least %d", F.col("n"),
                                    F.lit(MIN_CHART_POINTS)))
              .when(F.col("nv") == 0, F.lit("All Y values are null, undefined, or NaN"))
              .when(flat, F.format_string(
                  "Zero variance in Y values (all values ≈ %.4f) — chart conveys no information", mean)))
    pie = F.coalesce(F.lower(F.col("ctype")).contains("pie"), F.lit(False))
    warn = F.when(reason.isNull() & pie & (F.col("tot") > 0) & (F.col("mx") / F.col("tot") > PIE_DOMINANCE),
                  F.lit("One category accounts for > 95% of total — pie chart may not be informative"))
    return g.select(chart_col, reason.isNull().alias("valid"), reason.alias("reason"), warn.alias("warning"))


def kpi_check(value) -> Column:
    """struct(valid, reason) for a KPI value: null, NaN, infinite."""
    v = F.col(value) if isinstance(value, str) else value
    reason = (F.when(v.isNull(), F.lit("null value"))
              .when(F.isnan(v), F.lit("value is NaN"))
              .when(F.abs(v) == F.lit(float("inf")), F.lit("value is Infinity")))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def weekend_vs_weekday(df: DataFrame, date_col: str, value_col: str | None) -> DataFrame:
    """Average of the value on weekend days (Sat/Sun, UTC) against
    weekdays; a 0/unparseable value counts as 1 (reference rule).  Output
    one row (avg_weekend, avg_weekday, pct_diff, is_higher, weekend_rows,
    weekday_rows); pct_diff null unless both sides exist and weekday avg > 0."""
    d = F.col(date_col)
    v = F.lit(1.0) if value_col is None else F.col(value_col).cast("double")
    v = F.when(v.isNull() | (v == 0) | F.isnan(v), F.lit(1.0)).otherwise(v)
    we = F.dayofweek(d).isin(1, 7)
    row = df.filter(d.isNotNull()).agg(
        F.avg(F.when(we, v)).alias("awe"), F.avg(F.when(~we, v)).alias("awd"),
        F.count_if(we).alias("weekend_rows"), F.count_if(~we).alias("weekday_rows"))
    pct = F.when((F.col("weekend_rows") > 0) & (F.col("weekday_rows") > 0) & (F.col("awd") > 0),
                 floor_double((F.col("awe") - F.col("awd")) / F.col("awd") * F.lit(100.0) + F.lit(0.5)))
    return row.select(js_round("awe", 2).alias("avg_weekend"), js_round("awd", 2).alias("avg_weekday"),
                      pct.alias("pct_diff"), (pct > 0).alias("is_higher"),
                      "weekend_rows", "weekday_rows")


def series_summary(series: DataFrame, x: str = "x", y: str = "y", timeline: bool = True) -> DataFrame:
    """Total, mean, median, highest and lowest point (first in x order
    on ties), share of the highest in the total, first->last growth % for
    timelines, and the count of 2-sigma outliers (G4).  One row."""
    yv = F.col(y).cast("double")
    base = series.select(F.col(x).alias("x"), yv.alias("y")).filter(F.col("y").isNotNull())
    row = base.agg(
        F.sum("y").alias("total"), F.avg("y").alias("mean"),
        F.count(F.lit(1)).alias("points"), F.stddev_pop("y").alias("sd"),
        F.min(F.struct((-F.col("y")).alias("k"), F.col("x").alias("x"), F.col("y").alias("y"))).alias("hi"),
        F.min(F.struct(F.col("y").alias("k"), F.col("x").alias("x"), F.col("y").alias("y"))).alias("lo"),
        F.min_by("y", "x").alias("first_y"), F.max_by("y", "x").alias("last_y"))
    n_out = base.select(F.count_if(F.abs(F.col("y") - row.select("mean").scalar())
                                   > F.lit(SIGMA_OUTLIER) * row.select("sd").scalar())).scalar()
    median = group_medians(base, [], "y").select((F.col("lower") + F.col("upper")) / 2).scalar()
    share = F.when((F.col("hi.y") > 0) & (F.col("total") > 0), F.col("hi.y") / F.col("total") * F.lit(100.0))
    growth = F.when(F.lit(timeline) & (F.col("points") >= 2) & (F.col("first_y") != 0),
                    (F.col("last_y") - F.col("first_y")) / F.col("first_y") * F.lit(100.0)) \
        .otherwise(F.lit(0.0))
    return row.select(
        js_round("total", 2).alias("total"), js_round("mean", 6).alias("mean"), js_round(median, 6).alias("median"),
        "points", F.col("hi.x").alias("highest_x"), js_round("hi.y", 2).alias("highest_y"),
        F.col("lo.x").alias("lowest_x"), js_round("lo.y", 2).alias("lowest_y"),
        js_round(share, 2).alias("highest_share_pct"), (F.coalesce(share, F.lit(0.0)) >= SHARE_NOTABLE_PCT)
        .alias("highest_is_notable"), js_round(growth, 2).alias("growth_pct"),
        F.when((F.col("points") > 2) & (F.col("sd") > 0), n_out).otherwise(F.lit(0)).cast("long")
        .alias("outliers"))
