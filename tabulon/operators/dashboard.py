"""Dashboards: every KPI and every series of a dataset out of one pass over its
rows (A1-A3, A6, A7, A9-A12, A17, F8, T2, W3 together).

A list of specs becomes one plan.  Each row of the dataset is expanded, inside
the scan stage, to one small cell per spec that it has a value for: the spec's number, the period the
row lies in, the group it belongs to, and its value.  One grouped aggregate over
the cells follows, whose partial sums leave one row per spec, period and group
and partition before the shuffle.  Everything later (KPI values and their
comparison, averages, top groups with an 'Other' rest, series ranks, time
labels, down-sampling, forecasts) works on that grouped table, which is written
once, so the dataset is scanned once however many specs there are, and only the
columns that a spec names are read.

Specs are bounded by the recommender's limits (six KPIs, six charts) or by what
a user puts on a screen; their number sets the width of the expansion, never a
number of jobs.  Scatter charts show raw rows; they are an ordered limit of
their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import clean_number, floor_double
from ..session import written
from . import periods as PD
from . import series as SR
from . import stats as ST
from .filters import in_list, kind_of, threshold
from .rules import WARNING_RULE_IDS, Rule

ROWS = "_count"
NUMBERS = ("sum", "avg", "min", "max")
AGGREGATES = (*NUMBERS, "count", "distinct")
#: parts of a dataset's rows: outside both periods, in the prior one, in the current one
OUTSIDE, PRIOR, CURRENT = 0, 1, 2


@dataclass(frozen=True)
class Condition:
    """F8: rows that count. ``test`` is in, not in (null is neither) or present."""
    column: str
    test: str = "in"
    values: tuple = ()

    def holds(self, df: DataFrame) -> Column:
        c = F.col(self.column)
        if self.test == "present":
            return c.isNotNull() & (F.trim(c.cast("string")) != "") if kind_of(df.schema[self.column].dataType) == "string" else c.isNotNull()
        inside = F.coalesce(c.cast("string").isin([str(v) for v in self.values]), F.lit(False))
        return inside if self.test == "in" else c.isNotNull() & ~inside


@dataclass(frozen=True)
class Measure:
    """An aggregate (one of AGGREGATES) of a column, or of rows, under a condition."""
    column: str = ROWS
    aggregation: str = "count"
    condition: Condition | None = None


@dataclass(frozen=True)
class Kpi:
    """A KPI: one measure, or the share of one measure in another (``over``),
    in percent if the format is percent."""
    kpi: str
    title: str
    measure: Measure
    over: Measure | None = None
    format: str = "number"


@dataclass(frozen=True)
class Chart:
    """A series of ``y`` by ``x``, split by ``series`` if given; aggregation
    'none' gives raw points.  Dates are put into buckets of ``every`` (day, week,
    month, quarter, year), else of a size that follows from their span."""
    chart: str
    title: str
    chart_type: str
    x: str
    y: str = ROWS
    aggregation: str = "count"
    series: str | None = None
    series_cap: int = 5
    every: str | None = None


@dataclass
class Dashboard:
    """Results: ``cards`` (one row per KPI), ``points`` and ``forecasts`` of the charts,
    ``alerts`` of the rules that matched, ``filters`` (values to filter by)."""
    cards: DataFrame
    points: DataFrame
    forecasts: DataFrame
    alerts: DataFrame
    filters: DataFrame
    groups: DataFrame = field(repr=False, default=None)


# ------------------------------------------------------------------ one pass

def _number(df: DataFrame, column: str) -> Column:
    if column == ROWS:
        return F.lit(1.0)
    kind = kind_of(df.schema[column].dataType)
    return F.col(column).cast("double") if kind == "number" else clean_number(column) if kind == "string" else F.lit(None).cast("double")


def _measured(df: DataFrame, column: str, aggregation: str) -> Column:
    """The value of a row: its number, or for counts 1 where there is a value."""
    if aggregation in NUMBERS:
        return _number(df, column)
    return F.lit(1.0) if column == ROWS else F.when(F.col(column).isNotNull(), F.lit(1.0))


def _cell(item: int, part=OUTSIDE, key=None, series=None, value=None, seen=0) -> Column:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    part = F.lit(part) if isinstance(part, int) else part
    return F.struct(F.lit(item).alias("item"), part.cast("int").alias("part"), (text if key is None else key).alias("key"),
                    (text if series is None else series).alias("series"), (number if value is None else value.cast("double")).alias("v"),
                    (F.lit(seen) if isinstance(seen, int) else seen).cast("int").alias("seen"))


def _check(df: DataFrame, kpis: list[Kpi], charts: list[Chart], rules: list[Rule], options: list[str]) -> None:
    measures = [m for k in kpis for m in (k.measure, k.over) if m]
    named = [c for m in measures for c in (m.column, m.condition and m.condition.column)]
    named += [c for ch in charts for c in (ch.x, ch.y, ch.series)] + [c for r in rules for c in (r.column, r.in_column)] + options
    if unknown := {c for c in named if c and c != ROWS} - set(df.columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    wrong = {m.aggregation for m in measures} - set(AGGREGATES) | {c.aggregation for c in charts} - {*NUMBERS, "count", "none"}
    if wrong:
        raise ValueError(f"unknown aggregates {sorted(wrong)}")


def is_temporal(df: DataFrame, chart: Chart) -> bool:
    return kind_of(df.schema[chart.x].dataType) == "date"


def _bounds(df: DataFrame, column: str, bounds: dict | None) -> tuple[Column, Column]:
    """Smallest and largest date: as known (from a profile of the same rows), else
    by a scalar subquery over that one column."""
    kind = df.schema[column].dataType
    if bounds and column in bounds:
        lo, hi = bounds[column]
        as_lit = lambda d: F.lit(d.isoformat(" ") if isinstance(d, datetime) else d).cast(kind)
        return as_lit(lo), as_lit(hi)
    b = PD.date_bounds(df, column)
    return b.getField("min_date"), b.getField("max_date")


def grouped_cells(df: DataFrame, kpis: list[Kpi], charts: list[Chart], date_column: str | None = None, window: str | None = None,
                  bounds: dict | None = None, rules: list[Rule] = (), options: list[str] = ()) -> DataFrame:
    """(item, part, key, series, n, c, s, lo, hi, k, k_prior, k_current): rows, values, sum,
    smallest and largest value of every group; for distinct measures the number of
    distinct values, in all and in each period.  Items are numbered: two per
    KPI (its measure and what it is divided by), then the charts, the rules and the
    columns of filter options."""
    _check(df, kpis, charts, list(rules), list(options))
    part, derived = F.lit(OUTSIDE), {}  # what needs the bounds: a filter of an array can hold no subquery
    if date_column:
        p = PD.period_bounds(*_bounds(df, date_column, bounds), window)
        d = F.col(date_column)
        part = (F.when(d >= p.current_start, F.lit(CURRENT)).when((d >= p.prior_start) & (d < p.prior_end), F.lit(PRIOR))
                .otherwise(F.lit(OUTSIDE)))
        derived["__part"], part = part, F.col("__part")
    cells, distinct = [], []
    for i, k in enumerate(kpis):
        for item, m in ((2 * i, k.measure), (2 * i + 1, k.over)):
            if m is None:
                continue
            if m.aggregation == "distinct":
                distinct.append(item)
                key = F.col(m.column).cast("string")
                cell, holds = _cell(item, key=key, seen=F.when(part == CURRENT, 1 << CURRENT).when(part == PRIOR, 1 << PRIOR).otherwise(1)), key.isNotNull()
            else:
                cell, holds = _cell(item, part, value=_measured(df, m.column, m.aggregation)), None
            if m.condition:
                holds = m.condition.holds(df) if holds is None else holds & m.condition.holds(df)
            cells.append(cell if holds is None else F.when(holds, cell))
    for j, c in enumerate(charts):
        if c.aggregation == "none":
            continue
        item, value, series = 2 * len(kpis) + j, _measured(df, c.y, c.aggregation), c.series and SR.blank_key(c.series, SR.OTHER_LABEL)
        if is_temporal(df, c):
            if c.every:
                label = SR.bucket_label(F.col(c.x), c.every)
            else:
                derived[f"__grain{j}"] = SR.choose_granularity(*_bounds(df, c.x, bounds))
                label = SR.bucket_by(F.col(c.x), F.col(f"__grain{j}"))
            cells.append(F.when(F.col(c.x).isNotNull(), _cell(item, key=label, series=series, value=value)))
        else:
            cells.append(_cell(item, key=F.col(c.x).cast("string"), series=series, value=value))
    for j, r in enumerate(rules):
        holds = threshold(r.column, r.operator, r.threshold)
        if r.in_column:
            holds = holds & in_list(r.in_column, r.in_values)
        cells.append(F.when(holds, _cell(2 * len(kpis) + len(charts) + j)))
    for j, c in enumerate(options):
        text = F.col(c).cast("string")
        cells.append(F.when(text != "", _cell(2 * len(kpis) + len(charts) + len(rules) + j, key=text)))
    if not cells:
        cells = [F.when(F.lit(False), _cell(0))]
    # cells that a row does not have are dropped inside the array.  A filter of an array
    # also keeps Spark from compiling all cells into one method, too long for the JVM to optimise
    present = F.filter(F.array(*cells), lambda e: e.isNotNull())
    long = df.withColumns(derived).select(F.explode(present).alias("e")).select("e.*")
    sums = [F.count(F.lit(1)).alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    g = long.groupBy("item", "part", "key", "series").agg(*sums, F.bit_or("seen").alias("seen"))
    if not distinct:
        zero = F.lit(None).cast("long")
        return g.select("item", "part", "key", "series", "n", "c", "s", "lo", "hi", zero.alias("k"), zero.alias("k_prior"), zero.alias("k_current"))
    # the values of a distinct measure have done their work; their groups become one
    g = g.withColumn("key", F.when(~F.col("item").isin(distinct), F.col("key")))
    return g.groupBy("item", "part", "key", "series").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("seen").bitwiseAND(1 << PRIOR) != 0).alias("k_prior"),
        F.count_if(F.col("seen").bitwiseAND(1 << CURRENT) != 0).alias("k_current"))


# ------------------------------------------------------------------ KPI cards

def _value(aggregation: Column, n: str, c: str, s: str, lo: str, hi: str, k: str) -> Column:
    """The value of an aggregate from rows, values, sum, smallest, largest, distinct."""
    out = F.when(aggregation == "sum", F.col(s)).when(aggregation == "avg", F.col(s) / F.nullif(F.col(c), F.lit(0)))
    out = out.when(aggregation == "min", F.col(lo)).when(aggregation == "max", F.col(hi))
    return out.when(aggregation == "distinct", F.coalesce(F.col(k), F.lit(0)).cast("double")).otherwise(F.coalesce(F.col(n), F.lit(0)).cast("double"))


def cards_of(groups: DataFrame, kpis: list[Kpi], has_period: Column) -> DataFrame:
    """A6 + A7 from the grouped cells: one row per KPI, also for one without rows."""
    spark = groups.sparkSession
    specs = [(2 * i + j, i, j, m.aggregation) for i, k in enumerate(kpis) for j, m in enumerate((k.measure, k.over)) if m]
    names = [(i, k.kpi, k.title, k.format, k.measure.column, k.measure.aggregation, k.over is not None) for i, k in enumerate(kpis)]
    specs = spark.createDataFrame(specs, "item int, kpi_no int, side int, agg string")
    names = spark.createDataFrame(names, "kpi_no int, kpi string, title string, format string, column string, aggregation string, is_share boolean")
    aggs = []
    for p, part in (("a", F.lit(True)), ("p", F.col("part") == PRIOR), ("c", F.col("part") == CURRENT)):
        aggs += [F.sum(F.when(part, F.col(x))).alias(p + x) for x in ("n", "c", "s")]
        aggs += [F.min(F.when(part, F.col("lo"))).alias(p + "lo"), F.max(F.when(part, F.col("hi"))).alias(p + "hi")]
    aggs += [F.max("k").alias("ak"), F.max("k_prior").alias("pk"), F.max("k_current").alias("ck")]
    g = specs.join(groups.filter(F.col("item") < 2 * len(kpis)).groupBy("item").agg(*aggs), "item", "left")
    cols = {}
    for p in "apc":
        cols[p] = _value(F.col("agg"), *(p + x for x in ("n", "c", "s", "lo", "hi", "k")))
    filled = lambda p: F.coalesce(F.when(F.col("agg") == "distinct", F.col(p + "k")).otherwise(F.col(p + "c")), F.lit(0))
    m = g.select("kpi_no", "side", "agg", cols["a"].alias("va"), cols["p"].alias("vp"), cols["c"].alias("vc"),
                 filled("p").alias("np"), filled("c").alias("nc"))
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    m = m.groupBy("kpi_no").agg(*[of(c, j).alias(f"{c}{j}") for c in ("va", "vp", "vc", "np", "nc") for j in (0, 1)])
    j = names.join(m, "kpi_no")
    times = F.when(F.col("format") == "percent", F.lit(100.0)).otherwise(F.lit(1.0))
    val = {p: F.when(F.col("is_share"), F.coalesce(F.col(f"v{p}0"), F.lit(0.0)) / F.nullif(F.col(f"v{p}1"), F.lit(0.0)) * times).otherwise(F.col(f"v{p}0")) for p in "apc"}
    cnt = {p: F.when(F.col("is_share"), F.col(f"n{p}1")).otherwise(F.col(f"n{p}0")) for p in "pc"}
    j = j.select("*", val["a"].alias("all_time"), F.coalesce(val["p"], F.lit(0.0)).alias("prior_value"), F.coalesce(val["c"], F.lit(0.0)).alias("current_value"),
                 cnt["p"].cast("long").alias("prior_count"), cnt["c"].cast("long").alias("current_count"), F.coalesce(has_period, F.lit(False)).alias("has"))
    shown = F.when(F.col("has") & (F.col("aggregation") != "distinct"), F.col("current_value")).otherwise(F.coalesce("all_time", F.lit(0.0)))
    cmp = PD.compare(F.col("current_value"), F.col("prior_value"), F.col("current_count"), F.col("prior_count"), F.col("has"))
    return j.select((F.col("kpi_no") + 1).alias("rank"), "kpi", "title", "format", "column", "aggregation", shown.alias("value"), "all_time", "current_value",
                    "prior_value", "current_count", "prior_count", cmp.getField("delta_pct").alias("delta_pct"),
                    cmp.getField("delta_direction").alias("delta_direction"), cmp.getField("period").alias("period"))


# ------------------------------------------------------------------ charts

def _added() -> list[Column]:
    """Aggregates that join groups into one."""
    return [F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def _y() -> Column:
    v = _value(F.col("agg"), "n", "c", "s", "lo", "hi", "n")
    return F.when(F.col("agg") == "sum", F.coalesce(v, F.lit(0.0))).otherwise(v)


def points_of(groups: DataFrame, charts: DataFrame, cap: int = SR.SERVER_POINT_CAP) -> DataFrame:
    """Points of the charts (item, agg, temporal, series_cap) from their groups:
    item, position, x, series, y, n.

    A split chart keeps its ``series_cap`` largest series, the rest is 'Other'
    (A17).  A chart by categories of more than ``cap`` groups keeps the top
    cap - 1 and folds the rest into 'Other' (T2), a chart over time keeps every
    n-th point (W3).  Folding joins sums, counts and extremes, so an average of
    a rest is a true average.  The lists of kept groups hold at most cap rows a
    chart and are broadcast."""
    g = groups.join(F.broadcast(charts), "item")
    split = SR.fold_series(g.filter("series is not null"), ["item"], F.col("series_cap"), ["item", "key", "agg", "temporal"])
    g = g.filter("series is null").select("item", "key", "agg", "temporal", F.lit(0).alias("series_rank"), "series", "n", "c", "s", "lo", "hi")
    g = g.unionByName(split.select(*g.columns))
    whole = g.groupBy("item", "key", "agg", "temporal").agg(*_added()).withColumn("y", _y())
    # categories: which keys stay
    order = [F.desc_nulls_last("y"), F.asc_nulls_first("key")]
    ranked = whole.filter("not temporal").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= cap + 1)
    many = ranked.filter(F.col("rank") == cap + 1).select("item", F.lit(True).alias("many"))
    head = ranked.filter(F.col("rank") <= cap).join(F.broadcast(many), "item", "left").filter(F.col("many").isNull() | (F.col("rank") < cap))
    head = head.select(F.col("item").alias("h_item"), F.col("key").alias("h_key"), F.col("rank").alias("h_rank"))
    c = g.filter("not temporal")
    c = c.join(F.broadcast(head), (c["item"] == F.col("h_item")) & c["key"].eqNullSafe(F.col("h_key")), "left")
    c = c.withColumn("position", F.coalesce("h_rank", F.lit(cap))).withColumn("key", F.when(F.col("h_rank").isNull(), F.lit(SR.OTHER_LABEL)).otherwise(F.col("key")))
    c = c.groupBy("item", "position", "key", "agg", "series_rank", "series").agg(*_added())
    # time: labels sort in order of time; only the few buckets are numbered
    t = whole.filter("temporal").withColumn("idx", F.row_number().over(Window.partitionBy("item").orderBy("key")) - 1)
    t = t.withColumn("step", F.greatest(F.ceil(F.count(F.lit(1)).over(Window.partitionBy("item")) / F.lit(float(cap))), F.lit(1)))
    t = t.filter((F.col("idx") % F.col("step") == 0) & (F.col("idx") / F.col("step") < cap))
    t = t.select(F.col("item").alias("t_item"), F.col("key").alias("t_key"), (F.floor(F.col("idx") / F.col("step")) + 1).cast("int").alias("position"))
    times = g.filter("temporal").join(F.broadcast(t), (F.col("item") == F.col("t_item")) & (F.col("key") == F.col("t_key")))
    out = c.select("item", "position", "key", "agg", "series_rank", "series", "n", "c", "s", "lo", "hi").unionByName(
        times.select("item", "position", "key", "agg", "series_rank", "series", "n", "c", "s", "lo", "hi"))
    return out.select("item", "position", F.col("key").alias("x"), "series_rank", "series", _y().alias("y"), "n")


def scatter_points(df: DataFrame, chart: Chart, item: int, cap: int = SR.SERVER_POINT_CAP) -> DataFrame:
    """the first ``cap`` raw points in (x, y) order."""
    y = F.lit(None).cast("double") if chart.y == ROWS else _number(df, chart.y)
    p = df.select(F.col(chart.x).alias("x"), y.alias("y")).orderBy("x", "y").limit(cap)
    at = F.row_number().over(Window.orderBy("x", "y"))  # of at most cap rows
    return p.select(F.lit(item).alias("item"), at.alias("position"), F.col("x").cast("string").alias("x"), F.lit(0).alias("series_rank"),
                    F.lit(None).cast("string").alias("series"), "y", F.lit(1).cast("long").alias("n"))


def alerts_of(groups: DataFrame, rules: list[Rule], first: int) -> DataFrame:
    """Rules that match a row, with the number of rows."""
    named = [(first + j, r.rule_id, r.label, r.column, r.severity or ("warning" if r.rule_id in WARNING_RULE_IDS else "info")) for j, r in enumerate(rules)]
    named = groups.sparkSession.createDataFrame(named, "item int, rule_id string, label string, column string, severity string")
    hits = groups.groupBy("item").agg(F.sum("n").alias("triggered_count"))
    return named.join(hits, "item").select("rule_id", "label", "column", "triggered_count", "severity")


def options_of(groups: DataFrame, columns: list[str], first: int, limit: int = 25) -> DataFrame:
    """The first ``limit`` values of every column: column, value, rank."""
    named = groups.sparkSession.createDataFrame([(first + j, c) for j, c in enumerate(columns)], "item int, column string")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("key"))
    values = groups.filter((F.col("item") >= first) & (F.col("item") < first + len(columns))).select("item", "key", rank.cast("long").alias("rank"))
    return named.join(values.filter(F.col("rank") <= limit), "item").select("column", F.col("key").alias("value"), "rank")


def compile_dashboard(df: DataFrame, kpis: list[Kpi], charts: list[Chart], date_column: str | None = None, window: str | None = None,
                      bounds: dict | None = None, checked: bool = True, rules: list[Rule] = (), options: list[str] = ()) -> Dashboard:
    """All results of a dataset's specs, with the alerts of ``rules`` (A22) and the
    first 25 values of the columns ``options`` (A21).  ``bounds``: known (min, max) of date
    columns, else they are read first.  ``checked``: leave out charts that say
    nothing (G5) and KPIs that are no number (G6).  An empty dataset gives
    cards of 0 and no points."""
    spark = df.sparkSession
    groups = written(grouped_cells(df, kpis, charts, date_column, window, bounds, rules, options), "dashboard-groups")
    has = PD.period_bounds(*_bounds(df, date_column, bounds), window).has_bounds if date_column else F.lit(False)
    cards = cards_of(groups, kpis, has)
    if checked:
        cards = cards.filter(ST.kpi_check("value").getField("valid"))
    first = 2 * len(kpis)
    meta = [(first + j, c.chart, c.title, c.chart_type, c.x, c.y, c.aggregation, is_temporal(df, c), c.series_cap) for j, c in enumerate(charts)]
    meta = spark.createDataFrame(meta, "item int, chart string, title string, chart_type string, x_field string, y_field string, agg string, temporal boolean, series_cap int")
    points = points_of(groups.filter((F.col("item") >= first) & (F.col("item") < first + len(charts))), meta.select("item", "agg", "temporal", "series_cap"))
    for j, c in enumerate(charts):
        if c.aggregation == "none":
            points = points.unionByName(scatter_points(df, c, first + j))
    points = written(points, "dashboard-points")  # a few hundred rows a chart
    if checked:
        seen = points.groupBy("item", "position").agg(F.sum("y").alias("y")).join(meta.select("item", "chart_type"), "item")
        good = ST.chart_checks(seen, "item", "y", "chart_type", meta.select("item", "chart_type")).filter("valid").select("item")
        points = points.join(F.broadcast(good), "item", "left_semi")
    lines = points.groupBy("item", "position").agg(F.sum("y").alias("y")).join(meta.filter("chart_type = 'line' and agg <> 'none'").select("item"), "item", "left_semi")
    ahead = ST.forecast(lines, "position", "y", partition=["item"])
    named = meta.select("item", "chart", "title", "chart_type", "x_field", "y_field", F.col("agg").alias("aggregation"), (F.col("item") - first + 1).alias("rank"))
    alerts = alerts_of(groups, list(rules), first + len(charts))
    filters = options_of(groups, list(options), first + len(charts) + len(rules))
    return Dashboard(cards, points.join(F.broadcast(named), "item").drop("item"), ahead.join(F.broadcast(named), "item").drop("item"), alerts, filters, groups)
