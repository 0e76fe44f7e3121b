"""Period bounds, KPI cards and period comparison.

Dataset bounds (min/max of the date column) are computed by a scalar
subquery: Spark runs that aggregate once, before the main stage, and inlines
the single value.  So a KPI-card job is one partial+final aggregate over the
data with no join and nothing pulled to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import col_, floor_double

DAY_US = 24 * 60 * 60 * 1_000_000
# Relative windows and their length in days.
RELATIVE_WINDOWS = {"today": 1, "7days": 7, "30days": 30}
# Comparison period labels.
NO_CURRENT = "No data for this period"
NO_PRIOR = "No prior period data for comparison"
VS_PRIOR = "vs prior period"


def _us(c: Column) -> Column:
    """Epoch microseconds of a timestamp (NTZ or LTZ; session zone is UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def _ts(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def date_bounds(df: DataFrame, date_col: str) -> Column:
    """A4: struct(min_date, max_date) of a date column as a scalar subquery."""
    return df.select(F.struct(F.min(date_col).alias("min_date"),
                              F.max(date_col).alias("max_date"))).scalar()


def date_bounds_df(df: DataFrame, date_col: str) -> DataFrame:
    """A4 as a one-row DataFrame."""
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


@dataclass
class PeriodBounds:
    """A5 period bounds as Columns (all timestamps, NTZ)."""
    current_start: Column
    current_end: Column
    prior_start: Column
    prior_end: Column
    has_bounds: Column
    extra: dict = field(default_factory=dict)


def period_bounds(min_date: Column, max_date: Column, window: str | None = None) -> PeriodBounds:
    """A5: ``today/7days/30days`` back from the data's max date with a prior
    period of equal length; any other window splits the span in half."""
    lo, hi = _us(min_date), _us(max_date)
    if window in RELATIVE_WINDOWS:
        span = F.lit(RELATIVE_WINDOWS[window] * DAY_US)
        cur_start = hi - span
        prior_start = cur_start - span
    else:
        cur_start = lo + F.floor((hi - lo) / F.lit(2))
        prior_start = lo
    has = min_date.isNotNull() & max_date.isNotNull() & (min_date != max_date)
    return PeriodBounds(_ts(cur_start), max_date, _ts(prior_start), _ts(cur_start), has)


def period_bounds_scalar(df: DataFrame, date_col: str, window: str | None = None) -> Column:
    """A5 evaluated once: a scalar subquery returning struct(current_start,
    prior_start, prior_end, has_bounds), so rows only compare against
    constants."""
    b = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    pb = period_bounds(F.col("lo"), F.col("hi"), window)
    return b.select(F.struct(pb.current_start.alias("current_start"), pb.prior_start.alias("prior_start"),
                             pb.prior_end.alias("prior_end"), pb.has_bounds.alias("has_bounds"))).scalar()


def relative_date_filter(df: DataFrame, date_col: str, window: str | None) -> DataFrame:
    """keep rows with date >= max(date) - window; other values keep all."""
    if window not in RELATIVE_WINDOWS:
        return df
    mx = df.select(F.max(date_col)).scalar()
    start = _ts(_us(mx) - F.lit(RELATIVE_WINDOWS[window] * DAY_US))
    return df.filter(F.col(date_col) >= start)


def in_period(date: Column, start: Column, end: Column | None = None) -> Column:
    """half-open period predicate ``[start, end)``; no end = open."""
    c = date >= start
    return c if end is None else c & (date < end)


def compare(current: Column, prior: Column, current_n: Column, prior_n: Column,
            has_bounds: Column) -> Column:
    """struct(delta_pct, delta_direction, period)."""
    cur = F.coalesce(current, F.lit(0.0))
    pri = F.coalesce(prior, F.lit(0.0))
    cn = F.coalesce(current_n, F.lit(0))
    pn = F.coalesce(prior_n, F.lit(0))
    diff = cur - pri
    pct = floor_double(diff / F.abs(pri) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)
    delta = (F.when(~has_bounds, F.lit(None))
             .when(cn == 0, F.lit(None))
             .when(pn == 0, F.lit(None))
             .when(pri == 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
             .otherwise(pct)).cast("double")
    direction = (F.when(~has_bounds | (cn == 0) | (pn == 0), F.lit("flat"))
                 .when(pri == 0, F.when(cur > 0, F.lit("up")).otherwise(F.lit("flat")))
                 .when(diff > 0, F.lit("up")).when(diff < 0, F.lit("down"))
                 .otherwise(F.lit("flat")))
    period = (F.when(~has_bounds, F.lit(None).cast("string"))
              .when(cn == 0, F.lit(NO_CURRENT))
              .when(pn == 0, F.lit(NO_PRIOR))
              .otherwise(F.lit(VS_PRIOR)))
    return F.struct(delta.alias("delta_pct"), direction.alias("delta_direction"),
                    period.alias("period"))


@dataclass
class KpiSpec:
    """One KPI: a name, its column and aggregate (sum/avg/count/min/max/distinct)."""
    kpi: str
    column: str
    agg: str = "sum"
    label: str | None = None


_AGG = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _agg(agg: str, value: Column, cond: Column | None) -> Column:
    v = value if cond is None else F.when(cond, value)
    if agg == "count":
        return F.count_if(F.lit(True) if cond is None else cond).cast("double")
    if agg == "distinct":
        return F.count_distinct(v).cast("double")
    return _AGG[agg](v).cast("double")


def kpi_cards(df: DataFrame, kpis: list[KpiSpec], date_col: str | None = None,
              window: str | None = None) -> DataFrame:
    """A7 (with A2, A3, A6): one row per KPI.

    Columns: ordinal, kpi, label, agg, value (current period when a period
    exists, as the reference shows it), all_time, current_value, prior_value,
    current_count, prior_count, delta_pct, delta_direction, period.

    Plain KPIs (sum/avg/count/min/max) come out of one aggregate pass.
    Distinct KPIs are unpivoted to (kpi, value) and deduplicated by one
    ``groupBy`` carrying the period flags, so Spark shuffles each distinct
    value once (map-side combined) instead of expanding every row per
    ``count(distinct)``; nulls are not counted.
    """
    if date_col:
        pb = period_bounds_scalar(df, date_col, window)
        d = F.col(date_col)
        cur_c = in_period(d, pb.getField("current_start"))
        pri_c = in_period(d, pb.getField("prior_start"), pb.getField("prior_end"))
        has = F.coalesce(pb.getField("has_bounds"), F.lit(False))
    else:
        cur_c = pri_c = None
        has = F.lit(False)

    plain = [(i, k) for i, k in enumerate(kpis) if k.agg != "distinct"]
    distinct = [(i, k) for i, k in enumerate(kpis) if k.agg == "distinct"]
    parts = []
    if plain:
        aggs = []
        for i, k in plain:
            v = F.col(k.column)
            aggs.append(_agg(k.agg, v, None).alias(f"a{i}"))
            if cur_c is not None:
                aggs += [_agg(k.agg, v, cur_c).alias(f"c{i}"), _agg(k.agg, v, pri_c).alias(f"p{i}"),
                         F.count_if(cur_c & v.isNotNull()).alias(f"cn{i}"),
                         F.count_if(pri_c & v.isNotNull()).alias(f"pn{i}")]
        row = df.agg(*aggs)
        structs = []
        for i, k in plain:
            if cur_c is not None:
                cur = F.coalesce(F.col(f"c{i}"), F.lit(0.0))
                pri = F.coalesce(F.col(f"p{i}"), F.lit(0.0))
                cn, pn = F.col(f"cn{i}"), F.col(f"pn{i}")
                shown = F.when(has, cur).otherwise(F.col(f"a{i}"))
            else:
                cur = pri = F.lit(None).cast("double")
                cn = pn = F.lit(None).cast("long")
                shown = F.col(f"a{i}")
            structs.append(_card(i, k, shown, F.col(f"a{i}"), cur, pri, cn, pn, has))
        parts.append(row.select(F.inline(F.array(*structs))))
    if distinct:
        vals = F.array(*[F.struct(F.lit(i).alias("i"), F.col(k.column).cast("string").alias("v"))
                         for i, k in distinct])
        flags = [F.lit(False) if cur_c is None else cur_c, F.lit(False) if pri_c is None else pri_c]
        long = df.select(F.explode(vals).alias("e"), flags[0].alias("cur"), flags[1].alias("pri")) \
            .select("e.i", "e.v", "cur", "pri").filter(F.col("v").isNotNull())
        per_value = long.groupBy("i", "v").agg(F.max("cur").alias("cur"), F.max("pri").alias("pri"))
        counts = per_value.groupBy("i").agg(F.count("*").cast("double").alias("a"),
                                            F.count_if("cur").cast("double").alias("c"),
                                            F.count_if("pri").cast("double").alias("p"))
        # every distinct KPI gets a row, also when the column is all null
        ids = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i, _ in distinct])).alias("i"))
        counts = ids.join(counts, "i", "left").fillna(0.0, ["a", "c", "p"])
        branches = None
        for i, k in distinct:
            if cur_c is not None:
                cur, pri = F.col("c"), F.col("p")
                card = _card(i, k, F.col("a"), F.col("a"), cur, pri, cur.cast("long"), pri.cast("long"), has)
            else:
                nd, nl = F.lit(None).cast("double"), F.lit(None).cast("long")
                card = _card(i, k, F.col("a"), F.col("a"), nd, nd, nl, nl, has)
            branches = (F.when(F.col("i") == i, card) if branches is None
                        else branches.when(F.col("i") == i, card))
        parts.append(counts.select(branches.alias("c")).select("c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _card(i, k: KpiSpec, shown, allv, cur, pri, cn, pn, has) -> Column:
    cmp = compare(cur, pri, cn, pn, has)
    return F.struct(
        F.lit(i).alias("ordinal"), F.lit(k.kpi).alias("kpi"),
        F.lit(k.label or k.kpi).alias("label"), F.lit(k.agg).alias("agg"),
        F.coalesce(shown, F.lit(0.0)).alias("value"), allv.cast("double").alias("all_time"),
        cur.cast("double").alias("current_value"), pri.cast("double").alias("prior_value"),
        cn.cast("long").alias("current_count"), pn.cast("long").alias("prior_count"),
        cmp.getField("delta_pct").alias("delta_pct"),
        cmp.getField("delta_direction").alias("delta_direction"),
        cmp.getField("period").alias("period"))


def growth_card(cards: DataFrame, prefer=("revenue", "sales")) -> DataFrame:
    """Growth card for the 'revenue' KPI, else 'sales', else the first one.

    Works on the (small, one row per KPI) output of ``kpi_cards``.
    """
    rank = F.when(F.col("kpi") == prefer[0], 0)
    for j, p in enumerate(prefer[1:], start=1):
        rank = rank.when(F.col("kpi") == p, j)
    rank = rank.otherwise(len(prefer))
    best = cards.filter(F.col("period").isNotNull()).select(
        F.min_by(F.struct("*"), F.struct(rank, F.col("ordinal"))).alias("c")).select("c.*")
    label = F.when(F.col("kpi") == "revenue", F.lit("Revenue Growth %")) \
        .otherwise(F.concat(F.col("label"), F.lit(" Growth %")))
    return best.filter(F.col("kpi").isNotNull()).select(
        F.lit("growth").alias("kpi"), label.alias("label"),
        F.coalesce(F.col("delta_pct"), F.lit(0.0)).alias("value"),
        F.col("delta_direction"), F.col("period"))


def half_growth(df: DataFrame, date_col: str, metrics: list[str]) -> DataFrame:
    """Split the date span at its midpoint; growth of each metric's sum
    from the first half to the second.  Rows are (metric, first_half,
    second_half, growth_pct) with growth rounded to 1 dp, null when the first
    half sums to 0."""
    mid = period_bounds_scalar(df, date_col).getField("current_start")
    second = F.col(date_col) >= mid
    first = F.col(date_col) < mid
    aggs = []
    for i, m in enumerate(metrics):
        aggs += [F.sum(F.when(first, F.col(m))).alias(f"f{i}"),
                 F.sum(F.when(second, F.col(m))).alias(f"s{i}")]
    row = df.filter(F.col(date_col).isNotNull()).agg(*aggs)
    structs = []
    for i, m in enumerate(metrics):
        f, s = F.coalesce(F.col(f"f{i}"), F.lit(0.0)), F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        g = F.when(f != 0, floor_double((s - f) / F.abs(f) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))
        structs.append(F.struct(F.lit(m).alias("metric"), f.alias("first_half"),
                                s.alias("second_half"), g.cast("double").alias("growth_pct")))
    return row.select(F.inline(F.array(*structs)))
