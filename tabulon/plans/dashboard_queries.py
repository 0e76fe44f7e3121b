"""Registered queries over whole results and their oracles: dashboards (R17 to S12,
R11), largest series (A17), answers (R20), pages (T4), live tables (A10, A22).

The oracles are written from the rules, spec by spec: every KPI and every chart
has a query of its own there, while Spark runs one pass per dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dashboard as DB
from ..operators import paging as PG
from ..operators import periods as PD
from ..operators import profile as PF
from ..operators import rules as RU
from ..operators import series as SR
from ..session import ensure_checkpoint_dir, written
from ..sources.io import ResultStore
from ..sources.tables import table
from ..streaming import live as LV
from . import answers as AW
from . import dashboards as DS
from . import recommend_oracles as RO
from . import recommend_queries as RQ
from .catalog_queries import r2, register, sql_r
from .recommend import catalog as CT

K, M, C, IF = DB.Kpi, DB.Measure, DB.Chart, DB.Condition

#: dataset -> (date column, window, KPIs, charts)
SPECS = {
    "orders": ("o_orderdate", "30days", [
        K("revenue", "Revenue", M("o_totalprice", "sum"), format="currency"), K("mean_price", "Mean price", M("o_totalprice", "avg")),
        K("orders", "Orders", M("o_orderkey", "count")), K("customers", "Customers", M("o_custkey", "distinct")),
        K("open_orders", "Open orders", M("o_orderstatus", "count", IF("o_orderstatus", "in", ("O",)))),
        K("filled_share", "Filled", M("o_orderstatus", "count", IF("o_orderstatus", "in", ("F",))), M(), "percent")],
        [C("price_by_time", "Price over time", "line", "o_orderdate", "o_totalprice", "sum"), C("price_by_priority", "Price", "bar", "o_orderpriority", "o_totalprice", "avg"),
         C("by_status", "Status", "pie", "o_orderstatus"), C("by_customer", "Customers", "bar", "o_custkey", "o_totalprice", "sum"),
         C("priority_status", "Priority by status", "bar", "o_orderpriority", "o_totalprice", "sum", "o_orderstatus", 2)]),
    "lineitem": ("l_shipdate", None, [
        K("quantity", "Quantity", M("l_quantity", "sum")), K("most", "Highest price", M("l_extendedprice", "max")), K("least", "Lowest price", M("l_extendedprice", "min")),
        K("parts", "Parts", M("l_partkey", "distinct")),
        K("returned_share", "Returned", M("l_extendedprice", "sum", IF("l_returnflag", "in", ("R",))), M("l_extendedprice", "sum"), "percent")],
        [C("mean_by_time", "Mean over time", "line", "l_shipdate", "l_extendedprice", "avg"), C("by_supplier", "Suppliers", "bar", "l_suppkey", "l_quantity", "sum"),
         C("flag_supplier", "Flag by supplier", "bar", "l_returnflag", "l_quantity", "sum", "l_suppkey", 5)]),
    "events": ("ts", "7days", [
        K("value", "Value", M("value", "sum")), K("users", "Users", M("user_id", "distinct")),
        K("errors", "Errors", M("event_type", "count", IF("event_type", "in", ("error",)))), K("others", "Others", M("value", "avg", IF("event_type", "not in", ("error",))))],
        [C("value_by_time", "Value over time", "line", "ts", "value", "sum"), C("by_type", "Types", "bar", "event_type"), C("largest", "Largest", "bar", "event_type", "value", "max")]),
}

_DAYS = {"today": 1, "7days": 7, "30days": 30}


def _holds(c: DB.Condition | None) -> str:
    if c is None:
        return "TRUE"
    values = ", ".join(f"'{v}'" for v in c.values)
    return {"present": f"{c.column} IS NOT NULL", "in": f"{c.column} IN ({values})", "not in": f"{c.column} NOT IN ({values})"}[c.test]


def _measure_sql(m: DB.Measure, rows: str = "TRUE") -> str:
    f = f"FILTER (WHERE {_holds(m.condition)} AND {rows})"
    if m.aggregation == "count":
        return f"CAST(COUNT(*) {f} AS DOUBLE)"
    if m.aggregation == "distinct":
        return f"CAST(COUNT(DISTINCT {m.column}) {f} AS DOUBLE)"
    return f"CAST({m.aggregation.upper()}({m.column}) {f} AS DOUBLE)"


def _present_sql(m: DB.Measure, rows: str) -> str:
    if m.aggregation == "distinct":
        return f"COUNT(DISTINCT {m.column}) FILTER (WHERE {_holds(m.condition)} AND {rows})"
    return f"COUNT({'*' if m.column == DB.ROWS else m.column}) FILTER (WHERE {_holds(m.condition)} AND {rows})"


def kpi_sql(t: str, date: str | None, window: str | None, k: DB.Kpi) -> str:
    """dataset_id, kind, spec, position, x, series, y, n, prior, delta_pct, direction of one KPI."""
    if window in _DAYS:
        d = _DAYS[window]
        bounds = f"SELECT hi - INTERVAL {d} DAY AS c0, hi - INTERVAL {2 * d} DAY AS p0, lo <> hi AS has FROM (SELECT MIN({date}) AS lo, MAX({date}) AS hi FROM {t})"
    elif date:
        bounds = f"SELECT make_timestamp(epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 2) AS c0, lo AS p0, lo <> hi AS has FROM (SELECT MIN({date}) AS lo, MAX({date}) AS hi FROM {t})"
    else:
        bounds = "SELECT NULL AS c0, NULL AS p0, FALSE AS has"
    cur, pri = (f"{date} >= c0", f"{date} >= p0 AND {date} < c0") if date else ("FALSE", "FALSE")
    vals = []
    for name, rows in (("a", "TRUE"), ("c", cur), ("p", pri)):
        v = _measure_sql(k.measure, rows)
        if k.over:
            v = f"COALESCE({v}, 0) / NULLIF({_measure_sql(k.over, rows)}, 0){' * 100' if k.format == 'percent' else ''}"
        vals += [f"{v} AS v{name}", f"{_present_sql(k.over or k.measure, rows)} AS n{name}"]
    shown = "va" if k.measure.aggregation == "distinct" else "CASE WHEN has THEN COALESCE(vc, 0) ELSE COALESCE(va, 0) END"
    return f"""
SELECT '{t}' AS dataset_id, 'kpi' AS kind, '{k.kpi}' AS spec, 0 AS position, NULL AS x, NULL AS series, {sql_r(shown)} AS y, CAST(nc AS BIGINT) AS n,
       {sql_r('COALESCE(vp, 0)')} AS prior,
       CASE WHEN NOT has OR nc = 0 OR np = 0 THEN NULL WHEN COALESCE(vp, 0) = 0 THEN CASE WHEN vc > 0 THEN 100.0 ELSE 0.0 END
            ELSE FLOOR((vc - vp) / ABS(vp) * 1000 + 0.5) / 10 END AS delta_pct,
       CASE WHEN NOT has OR nc = 0 OR np = 0 THEN 'flat' WHEN COALESCE(vp, 0) = 0 THEN CASE WHEN vc > 0 THEN 'up' ELSE 'flat' END
            WHEN vc > vp THEN 'up' WHEN vc < vp THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT has, {', '.join(vals)} FROM {t} CROSS JOIN ({bounds}) GROUP BY has)"""


def _y_sql(c: DB.Chart) -> str:
    if c.aggregation == "count" or c.y == DB.ROWS:
        return "CAST(COUNT(*) AS DOUBLE)"
    return f"CAST({c.aggregation.upper()}({c.y}) AS DOUBLE)"


def chart_sql(t: str, c: DB.Chart, temporal: bool, cap: int = 100) -> str:
    """The points of one chart, in the columns of :func:`kpi_sql`."""
    if temporal:
        label = (f"CASE WHEN d <= 31 THEN strftime({c.x}, '%Y-%m-%d') WHEN d <= 180 THEN strftime({c.x}, '%G-W%V') WHEN d <= 730 THEN strftime({c.x}, '%Y-%m') "
                 f"WHEN d <= 2000 THEN strftime({c.x}, '%Y') || '-Q' || quarter({c.x}) ELSE strftime({c.x}, '%Y') END")
        rows = f"SELECT *, {label} AS k FROM {t} CROSS JOIN (SELECT (epoch_us(MAX({c.x})) - epoch_us(MIN({c.x}))) / 86400e6 AS d FROM {t}) WHERE {c.x} IS NOT NULL"
        keys = f"""SELECT k, k AS kk, CAST(CEIL(idx / step) AS BIGINT) + 1 AS position FROM (
                   SELECT k, ROW_NUMBER() OVER (ORDER BY k) - 1 AS idx, GREATEST(CEIL(COUNT(*) OVER () / {float(cap)}), 1) AS step FROM (SELECT DISTINCT k FROM r))
                   WHERE idx % step = 0 AND idx / step < {cap}"""
    else:
        rows = f"SELECT *, CAST({c.x} AS VARCHAR) AS k FROM {t}"
        keys = f"""SELECT k, CASE WHEN total <= {cap} OR rk < {cap} THEN k ELSE 'Other' END AS kk, CASE WHEN total <= {cap} THEN rk ELSE LEAST(rk, {cap}) END AS position
                   FROM (SELECT k, ROW_NUMBER() OVER (ORDER BY y DESC NULLS LAST, k NULLS FIRST) AS rk, COUNT(*) OVER () AS total FROM (SELECT k, {_y_sql(c)} AS y FROM r GROUP BY k))"""
    label = series = "CAST(NULL AS VARCHAR)"
    if c.series:
        label = f"COALESCE(NULLIF(TRIM(CAST({c.series} AS VARCHAR)), ''), 'Other')"
        series = f"CASE WHEN s IN (SELECT s FROM (SELECT s, SUM({c.y}) AS total FROM r GROUP BY s) WHERE s <> 'Other' ORDER BY total DESC, s LIMIT {c.series_cap}) THEN s ELSE 'Other' END"
    return f"""
SELECT '{t}' AS dataset_id, 'point' AS kind, '{c.chart}' AS spec, CAST(position AS INT) AS position, x, series, {sql_r('y')} AS y, n,
       CAST(NULL AS DOUBLE) AS prior, CAST(NULL AS DOUBLE) AS delta_pct, CAST(NULL AS VARCHAR) AS direction
FROM (WITH r AS (SELECT *, {label} AS s FROM ({rows})), keys AS ({keys}), p AS (
  SELECT position, kk AS x, {series} AS series, {_y_sql(c)} AS y, COUNT(*) AS n FROM r JOIN keys ON r.k IS NOT DISTINCT FROM keys.k GROUP BY ALL),
  w AS (SELECT position, SUM(y) AS y FROM p GROUP BY position)
  SELECT p.* FROM p WHERE (SELECT COUNT(*) >= 2 AND NOT COALESCE(ABS(AVG(y)) > 1e-10 AND STDDEV_POP(y) / ABS(AVG(y)) < 0.001, FALSE) FROM w))"""


def dashboard_sql(specs: dict, dates: tuple[str, ...]) -> str:
    parts = [q for t, (date, window, kpis, charts) in specs.items()
             for q in [*(kpi_sql(t, date, window, k) for k in kpis), *(chart_sql(t, c, c.x in dates) for c in charts)]]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


_DATES = ("o_orderdate", "l_shipdate", "ts")


def _flat(cards, points):
    """Cards and points as rows of one shape."""
    none = lambda t: F.lit(None).cast(t)
    a = cards.select("dataset_id", F.lit("kpi").alias("kind"), F.col("kpi").alias("spec"), F.lit(0).alias("position"), none("string").alias("x"), none("string").alias("series"),
                     r2("value").alias("y"), F.col("current_count").alias("n"), r2("prior_value").alias("prior"), "delta_pct", F.col("delta_direction").alias("direction"))
    b = points.select("dataset_id", F.lit("point").alias("kind"), F.col("chart").alias("spec"), "position", "x", "series", r2("y").alias("y"), "n",
                      none("double").alias("prior"), none("double").alias("delta_pct"), none("string").alias("direction"))
    return a.unionByName(b)


def _new_store(spark) -> ResultStore:
    return ResultStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/dashboards-{uuid.uuid4().hex}")


@register("s12_dashboard", dashboard_sql(SPECS, _DATES))
def s12_dashboard(spark, base):
    """KPIs (plain, distinct, with a condition, shares) and charts (over time, by
    category with a rest, split by the largest series) of three datasets: one
    pass each, results stored and read back."""
    store = _new_store(spark)
    for name, (date, window, kpis, charts) in SPECS.items():
        store.put(DS.results_of(DB.compile_dashboard(table(spark, base, name), kpis, charts, date, window), name), [name])
    return _flat(store.read("cards"), store.read("points"))


# what R1 to R17 recommend for these tables, and A31 makes of the aggregates
RECOMMENDED = {
    "orders": ("o_orderdate", "30days", [
        K("o_totalprice_sum", "", M("o_totalprice", "sum")), K("o_custkey_sum", "", M("o_custkey", "sum")), K("avg_resolution_time", "", M("o_custkey", "avg")),
        K("o_orderkey_count_distinct", "", M("o_orderkey", "distinct")), K("total_tickets", "", M("o_orderkey", "count"))],
        [C("chart-1", "", "line", "o_orderdate", "o_totalprice", "sum"), C("chart-2", "", "line", "o_orderdate", "o_custkey", "sum"),
         C("chart-3", "", "bar", "o_orderstatus", "o_totalprice", "sum"), C("chart-4", "", "bar", "o_orderpriority", "o_totalprice", "sum"),
         C("chart-5", "", "bar", "o_orderstatus", "o_custkey", "sum"), C("chart-6", "", "bar", "o_orderpriority", "o_custkey", "sum")]),
    "events": ("ts", "30days", [
        K("value_sum", "", M("value", "sum")), K("event_id_count_distinct", "", M("event_id", "distinct")), K("user_id_count_distinct", "", M("user_id", "distinct"))],
        [C("chart-1", "", "line", "ts", "value", "sum"), C("chart-2", "", "bar", "event_type", "value", "sum"), C("chart-3", "", "line", "ts"), C("chart-4", "", "bar", "event_type")]),
    "customer": (None, "30days", [
        K("c_nationkey_sum", "", M("c_nationkey", "sum")), K("c_custkey_count_distinct", "", M("c_custkey", "distinct")), K("c_acctbal_count_distinct", "", M("c_acctbal", "distinct"))],
        [C("chart-1", "", "bar", "c_mktsegment", "c_nationkey", "sum"), C("chart-2", "", "bar", "c_mktsegment")]),
}


@register("r17_dashboard", dashboard_sql({t: (d, w if d else None, k, c) for t, (d, w, k, c) in RECOMMENDED.items()}, _DATES))
def r17_dashboard(spark, base):
    """The recommended KPIs and charts, computed and stored."""
    store = _new_store(spark)
    DS.store_dashboards(spark, base, RQ._run(spark, base), list(RECOMMENDED), store, "30days")
    return _flat(store.read("cards"), store.read("points"))


# ---------------------------------------------------------------- R11, F8

_STAFF_SQL = """
SELECT c_custkey AS employee_id, CASE c_nationkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'current' WHEN 2 THEN 'Left' WHEN 3 THEN 'Employed' ELSE 'On leave' END AS employment_status,
       CASE WHEN c_nationkey % 5 = 2 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 300 AS INT)) END AS exit_date, c_acctbal AS monthly_salary
FROM customer"""


def _staff(spark, base):
    """A staff list made of the customers."""
    kind = F.col("c_nationkey") % 5
    status = F.when(kind == 0, "Active").when(kind == 1, "current").when(kind == 2, "Left").when(kind == 3, "Employed").otherwise("On leave")
    left = F.when(kind == 2, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("c_custkey") % 300).cast("int")))
    return table(spark, base, "customer").select(F.col("c_custkey").alias("employee_id"), status.alias("employment_status"), left.alias("exit_date"), F.col("c_acctbal").alias("monthly_salary"))


@register("r11_composite", f"""
WITH e AS ({_STAFF_SQL})
SELECT 'active_employees' AS kpi, 'employment_status' AS "column", CAST(COUNT(*) FILTER (WHERE employment_status IN ('Active', 'active', 'ACTIVE', 'Current', 'current', 'Employed')) AS DOUBLE) AS value FROM e
UNION ALL SELECT 'attrition_rate', 'exit_date', {sql_r('COUNT(exit_date) * 100.0 / COUNT(*)')} FROM e
UNION ALL SELECT 'total_employees', 'employee_id', CAST(COUNT(DISTINCT employee_id) AS DOUBLE) FROM e
""")
def r11_composite(spark, base):
    """From a dataset's profile over the templates with a condition and a ratio to
    their values."""
    staff = written(_staff(spark, base), "staff")
    profile = PF.profile(staff, with_samples=False).withColumn("dataset_id", F.lit("employee_staff"))
    run = CT.Recommendation(written(profile.select(*CT.PROFILE_COLUMNS), "staff-profile"))
    plans = DS.Plans(run, ["employee_staff"])
    wanted = [k for k in plans.kpis["employee_staff"] if k.kpi in ("active_employees", "attrition_rate", "total_employees", "employee_id_count_distinct")]
    cards = DB.compile_dashboard(staff, wanted, []).cards
    name = F.when(F.col("kpi") == "employee_id_count_distinct", F.lit("total_employees")).otherwise(F.col("kpi"))
    return cards.select(name.alias("kpi"), "column", r2("value").alias("value"))


# ---------------------------------------------------------------- A17

def _top_series_sql(agg: str, cap: int) -> str:
    total = "COUNT(*)" if agg == "COUNT" else "SUM(v)"
    value = {"SUM": "SUM(v)", "AVG": "AVG(v)", "COUNT": "CAST(COUNT(*) AS DOUBLE)"}[agg]
    at = lambda k, name: f"{sql_r(f'MAX(g.y) FILTER (WHERE rk = {k})')} AS y_{name}, MAX(g.n) FILTER (WHERE rk = {k}) AS n_{name}"
    cols = "".join(f", (SELECT s FROM head WHERE rk = {k}) AS label_{k}, {at(k, k)}" for k in range(1, cap + 1))
    return f"""
WITH r AS (SELECT l_returnflag AS x, COALESCE(CAST(l_suppkey AS VARCHAR), 'Other') AS s, COALESCE(l_extendedprice, 0) AS v FROM lineitem),
head AS (SELECT s, ROW_NUMBER() OVER (ORDER BY total DESC, s) AS rk FROM (SELECT s, {total} AS total FROM r WHERE s <> 'Other' GROUP BY s) QUALIFY rk <= {cap}),
g AS (SELECT x, COALESCE(rk, {cap + 1}) AS rk, {value} AS y, COUNT(*) AS n FROM r LEFT JOIN head USING (s) GROUP BY ALL),
w AS (SELECT x, {value} AS y, COUNT(*) AS n FROM r GROUP BY x)
SELECT w.x, {sql_r('w.y')} AS y, w.n{cols}, {at(cap + 1, 'other')} FROM w JOIN g ON w.x = g.x GROUP BY w.x, w.y, w.n"""


def _rounded(df):
    return df.select(*[r2(c).alias(c) if c == "y" or c.startswith("y_") else F.col(c) for c in df.columns])


@register("a17_top_series", _top_series_sql("SUM", 5))
def a17_top_series(spark, base):
    """Price by return flag, split by the five largest suppliers and all others."""
    return _rounded(SR.top_series(table(spark, base, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice", "sum", 5))


@register("a17_top_series_avg", _top_series_sql("AVG", 3))
def a17_top_series_avg(spark, base):
    return _rounded(SR.top_series(table(spark, base, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice", "avg", 3))


@register("a17_top_series_count", _top_series_sql("COUNT", 4))
def a17_top_series_count(spark, base):
    return _rounded(SR.top_series(table(spark, base, "lineitem"), "l_returnflag", "l_suppkey", None, "count", 4))


# ---------------------------------------------------------------- R20

#: what is asked after a turn of a conversation, and about which dataset
_ASKED = [("orders", "top 3 o_totalprice by o_orderpriority"), ("orders", "average o_totalprice by o_orderstatus"), ("orders", "o_totalprice by month"),
          ("lineitem", "worst 2 l_quantity by l_returnflag"), ("lineitem", "maximum l_extendedprice by l_linestatus"), ("events", "how many rows by event_type"),
          ("events", "value trend"), ("orders", "by o_orderpriority")]
_KINDS = RO.KINDS
_VALUES = ", ".join(f"({i}, '{d}', '{t}')" for i, (d, t) in enumerate(_ASKED))
_TURNS = f"""SELECT asked.d AS dataset_id, conv_id || '-' || turn AS question_id, text || ' ' || t AS question
      FROM conversations JOIN (VALUES {_VALUES}) asked(i, d, t) ON asked.i = conv_id % {len(_ASKED)} WHERE role = 'user'"""


def _pairs_sql() -> str:
    one = lambda d, x, k, m: (f"SELECT '{d}' AS dataset_id, '{x}' AS x, '{m}' AS metric, {k} AS key, COUNT(*) AS n, COUNT({m}) AS c, CAST(SUM({m}) AS DOUBLE) AS s, "  # noqa: E731
                              f"CAST(MIN({m}) AS DOUBLE) AS lo, CAST(MAX({m}) AS DOUBLE) AS hi FROM {d}{f' WHERE {x} IS NOT NULL' if 'strftime' in k else ''} GROUP BY ALL")
    return "\nUNION ALL ".join([one(d, x, f"COALESCE(CAST({x} AS VARCHAR), 'Unknown')", m) for d, (ms, xs, _) in _KINDS.items() for x in xs for m in ms]
                               + [one(d, x, f"strftime({x}, '%Y-%m')", m) for d, (ms, _, xs) in _KINDS.items() for x in xs for m in ms])


@register("r20_answers", f"""
WITH {RO.routing_sql(_TURNS, RO.KINDS, (CT.COMPARE_WORDS_RE, CT.TOP_WORDS_RE, CT.ASC_WORDS_RE), CT.AGG_WORDS)},
pairs AS ({_pairs_sql()}),
j AS (SELECT r.dataset_id, question_id, action, aggregation AS agg, "limit" AS lim, direction = 'asc' AS up, pairs.* EXCLUDE (dataset_id, x, metric)
      FROM routed r JOIN pairs ON pairs.dataset_id = r.dataset_id AND pairs.x = COALESCE(r.date_column, r.group_by) AND pairs.metric = r.metric),
g AS (SELECT dataset_id, question_id, action, CAST(NULL AS INT) AS position, key,
        {sql_r("CASE WHEN agg = 'count' OR c = 0 THEN n WHEN agg = 'avg' THEN s / c WHEN agg = 'min' THEN lo WHEN agg = 'max' THEN hi ELSE s END")} AS value,
        CAST(NULL AS DOUBLE) AS change_pct, n FROM j WHERE action = 'group_by'),
t AS (SELECT dataset_id, question_id, action, CAST(ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY CASE WHEN up THEN v ELSE -v END, key) AS INT) AS position, key, v AS value,
        CAST(NULL AS DOUBLE) AS change_pct, n FROM (SELECT *, {sql_r('COALESCE(s, 0)')} AS v FROM j WHERE action = 'top_n') QUALIFY position <= lim),
c AS (SELECT dataset_id, question_id, action, CAST(ROW_NUMBER() OVER w AS INT) AS position, key, v AS value,
        CASE WHEN LAG(raw) OVER w > 0 THEN FLOOR((v - LAG(raw) OVER w) / LAG(raw) OVER w * 100 + 0.5) ELSE 0 END AS change_pct, n
      FROM (SELECT *, COALESCE(s, 0) AS raw, {sql_r('COALESCE(s, 0)')} AS v FROM j WHERE action = 'compare_periods') WINDOW w AS (PARTITION BY question_id ORDER BY key))
SELECT * FROM g UNION ALL SELECT * FROM t UNION ALL SELECT * FROM c
""")
def r20_answers(spark, base):
    """Every user turn of the conversations, with a question about a dataset, answered."""
    conv = table(spark, base, "conversations").filter("role = 'user'")
    asked = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(t).alias("t")) for d, t in _ASKED])
    pick = F.get(asked, F.pmod(F.col("conv_id"), F.lit(len(_ASKED))).cast("int"))
    qs = conv.select(pick.getField("d").alias("dataset_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
                     F.concat_ws(" ", "text", pick.getField("t")).alias("question"))
    routed = CT.route_questions(qs, RQ._profile(spark, base))
    return AW.answer(routed, lambda dataset: table(spark, base, dataset)).joined()


# ---------------------------------------------------------------- T4

_LINE_ORDER = ["-l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LINE_ORDER_SQL = ", ".join(f"{k[1:]} DESC NULLS LAST" if k[0] == "-" else f"{k} NULLS FIRST" for k in _LINE_ORDER)


@register("t04_page_1000", f"SELECT * FROM lineitem ORDER BY {_LINE_ORDER_SQL} LIMIT 3 OFFSET 2997")
def t04_page_1000(spark, base):
    """Page 1,000 of 3 rows from a sorted index."""
    li = table(spark, base, "lineitem")
    return PG.PageIndex.build(li, _LINE_ORDER, range_rows=1000).page(1000, 3).select(*li.columns)


@register("t04_next_page", f"SELECT * FROM lineitem ORDER BY {_LINE_ORDER_SQL} LIMIT 10 OFFSET 10")
def t04_next_page(spark, base):
    """The page after the first one, from its last row on."""
    li = table(spark, base, "lineitem")
    last = PG.next_page(li, _LINE_ORDER, None, 10).collect()[-1]
    return PG.next_page(li, _LINE_ORDER, last.asDict(), 10)


# ---------------------------------------------------------------- A10, A22 live

def _arrivals(spark, base, folder):
    """Event files as they arrive: four quarters of the time, the second one sent
    again, and some of its last hours held back until after the third."""
    ev = table(spark, base, "events")
    lo, hi = ev.select(F.min("ts")).scalar(), ev.select(F.max("ts")).scalar()
    quarter = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) * 4
                              / (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp")))), F.lit(3))
    parts = written(ev.withColumn("quarter", quarter), "event-quarters")
    last = parts.filter("quarter = 1").select(F.max("ts")).scalar()
    late = (F.col("quarter") == 1) & (F.col("ts") >= last - F.expr("INTERVAL 6 HOURS")) & (F.col("event_id") % 3 == 0)
    for rows in (parts.filter("quarter = 0"), parts.filter(F.col("quarter") == 1).filter(~late), parts.filter(F.col("quarter") == 1), parts.filter("quarter = 2"),
                 parts.filter("quarter = 0"), parts.filter("quarter = 3")):
        yield rows.drop("quarter").write.mode("append").parquet(folder)


_CLOSED = "date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY"


def _live(spark, base, make):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    live = LV.LiveTable(spark, folder, table(spark, base, "events").schema, make)
    for _ in _arrivals(spark, base, folder):
        live.catch_up()
    return live.read()


@register("a10_live", f"""
SELECT strftime(ts, '%Y-%m-%d') AS x, {sql_r('SUM(value)')} AS y, COUNT(*) AS n FROM events WHERE {_CLOSED} GROUP BY 1
""")
def a10_live(spark, base):
    """Daily sums of a stream with files sent twice and late rows: the days that the
    watermark has closed equal those of all events."""
    out = _live(spark, base, lambda s: LV.windowed_series(LV.once_each(s, "event_id", "ts"), "ts", "value", "sum", watermark=None))
    return out.select("x", r2("y").alias("y"), "n")


@register("a22_live", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, rule_id, COUNT(*) AS triggered_count
FROM (SELECT ts, 'large' AS rule_id FROM events WHERE value > 20 AND {_CLOSED} UNION ALL SELECT ts, 'errors' FROM events WHERE value < 3 AND event_type IN ('error') AND {_CLOSED})
GROUP BY ALL
""")
def a22_live(spark, base):
    rules = [RU.Rule("large", "Large value", "value", 20, ">"), RU.Rule("errors", "Small error", "value", 3, "<", in_column="event_type", in_values=["error"])]
    out = _live(spark, base, lambda s: LV.windowed_alerts(LV.once_each(s, "event_id", "ts"), "ts", rules, watermark=None))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rule_id", "triggered_count")


# ---------------------------------------------------------------- A8

_GROWTH = kpi_sql("orders", "o_orderdate", "30days", K("revenue", "", M("o_totalprice", "sum")))


@register("a08_growth", f"""
SELECT 'growth' AS kpi, 'Revenue Growth %' AS label, COALESCE(delta_pct, 0.0) AS value, direction AS delta_direction,
       CASE WHEN n = 0 THEN 'No data for this period' WHEN prior = 0 THEN 'No prior period data for comparison' ELSE 'vs prior period' END AS period FROM ({_GROWTH})
""")
def a08_growth(spark, base):
    """The growth card prefers the revenue KPI over the first one."""
    cards = PD.kpi_cards(table(spark, base, "orders"), [PD.KpiSpec("orders", "o_orderkey", "count", "Orders"), PD.KpiSpec("revenue", "o_totalprice", "sum", "Revenue")], "o_orderdate", "30days")
    return PD.growth_card(cards)
