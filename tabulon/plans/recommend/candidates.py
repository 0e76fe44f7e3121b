"""KPI and chart candidates, pre-run checks, scores, deduplication and
limits (R9, R10, R14, R15, R16, R17, W4).

All steps are column expressions and windows partitioned by ``dataset_id``
over the (small) intent tables, so one job ranks the recommendations of every
dataset in the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import semantics as S

# Display format by role.
ROLE_FORMAT = {
    S.MONETARY: "currency", S.ADDITIVE: "number", S.PERCENTAGE: "percent", S.RATIO: "percent",
    S.ORDINAL: "number", S.DEMOGRAPHIC: "number", S.NON_ADDITIVE: "number", S.IDENTIFIER: "number",
}
# Business value of a role, chart-type fit by x role.
ROLE_BUSINESS_VALUE = {
    S.MONETARY: 95, S.ADDITIVE: 85, S.PERCENTAGE: 80, S.ORDINAL: 72, S.RATIO: 70, S.DEMOGRAPHIC: 60,
    S.STATUS: 75, S.CATEGORICAL: 70, S.GEOGRAPHIC: 65, S.TEMPORAL: 80, S.IDENTIFIER: 50, S.TEXT: 30,
    S.CONTACT: 0, S.SENSITIVE: 0, S.NON_ADDITIVE: 55, S.UNKNOWN: 20,
}
CHART_TYPE_FIT = {
    S.TEMPORAL: {"line": 100, "area": 95, "bar": 65, "pie": 20, "scatter": 30},
    S.CATEGORICAL: {"bar": 100, "pie": 85, "line": 45, "area": 40, "scatter": 20},
    S.GEOGRAPHIC: {"bar": 90, "pie": 70, "line": 40, "area": 35, "scatter": 20},
    S.STATUS: {"pie": 100, "bar": 85, "line": 30, "area": 25, "scatter": 10},
    S.ORDINAL: {"bar": 90, "pie": 60, "line": 55, "area": 50, "scatter": 30},
    S.IDENTIFIER: {"bar": 70, "pie": 50, "line": 30, "area": 25, "scatter": 10},
}
MAX_NULL_RATIO_FOR_KPI = 0.60
MAX_PIE_CATEGORIES = 10
MAX_CATEGORICAL_CARDINALITY = 50
KPI_MAX = 6
PRIMARY_CHART_MAX = 6
SECONDARY_CHART_MAX = 3
TOTAL_CHART_MAX = 6


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def title_case(name: Column) -> Column:
    """'_' -> ' ', first letter of every word upper-cased (rest unchanged)."""
    words = F.split(F.regexp_replace(name, "_", " "), " ")
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.array_join(cap, " ")


def kpi_title(column: Column, agg: Column) -> Column:
    label = title_case(column)
    a = F.lower(agg)
    return (F.when(a.isin("count", "count_distinct", "sum"), F.concat(F.lit("Total "), label))
            .when(a == "avg", F.concat(F.lit("Average "), label))
            .when(a == "max", F.concat(F.lit("Maximum "), label))
            .when(a == "min", F.concat(F.lit("Minimum "), label))
            .otherwise(F.concat(label, F.lit(" Overview"))))


def chart_title(typ: Column, x: Column, y: Column) -> Column:
    xl = title_case(x)
    yl = F.when((y == "_count") | y.isNull(), F.lit("Count")).otherwise(title_case(y))
    return (F.when(typ == "time_series", F.concat(yl, F.lit(" Over Time")))
            .when(typ == "categorical_breakdown", F.concat(yl, F.lit(" by "), xl))
            .when(typ == "frequency_distribution", F.concat(xl, F.lit(" Distribution")))
            .when(typ == "proportion", F.concat(xl, F.lit(" Breakdown")))
            .when(typ == "correlation", F.concat(xl, F.lit(" vs "), yl))
            .otherwise(F.concat(yl, F.lit(" by "), xl)))


def _agg_fit(role: Column, agg: Column) -> Column:
    """Aggregation suitability 100 preferred / 70 allowed / 0."""
    forb = F.coalesce(F.array_contains(S.forbidden_of(role), agg), F.lit(False))
    pref = F.coalesce(F.array_contains(S.preferred_of(role), agg), F.lit(False))
    allo = F.coalesce(F.array_contains(S.allowed_of(role), agg), F.lit(False))
    return F.when(S.allowed_of(role).isNull(), F.lit(0)).when(forb, F.lit(0)).when(pref, F.lit(100)) \
        .when(allo, F.lit(70)).otherwise(F.lit(0))


def _type_fit(ctype: Column, xrole: Column) -> Column:
    kv = []
    for r, m in CHART_TYPE_FIT.items():
        kv += [F.lit(r), _map(m)]
    fits = F.create_map(*kv)[xrole]
    return F.when(fits.isNull(), F.lit(50)).otherwise(F.coalesce(fits[F.lower(ctype)], F.lit(40)))


def _valid_agg(role: Column, agg: Column) -> Column:
    """The aggregation after R4 validation (None when nothing is valid)."""
    forb = F.coalesce(F.array_contains(S.forbidden_of(role), agg), F.lit(False))
    allo = F.coalesce(F.array_contains(S.allowed_of(role), agg), F.lit(False)) | (agg == "none")
    return F.when(S.allowed_of(role).isNull(), F.lit("count")) \
        .when(~forb & allo, agg).otherwise(S.default_of(role))


def kpi_candidates(intents: DataFrame, sem: DataFrame) -> DataFrame:
    """R9 (+ R14 KPI checks + R15 quality): KPI candidates with reject reasons."""
    s = sem.select("dataset_id", F.col("column").alias("x_column"), F.col("semantic_role").alias("col_role"),
                   "is_sensitive", "null_ratio_f", F.coalesce(F.col("missing_pct"), F.lit(0.0)).alias("missing_pct"))
    k = intents.filter(F.col("kind") == "kpi").join(s, ["dataset_id", "x_column"], "left")
    agg = _valid_agg(F.col("col_role"), F.col("aggregation"))
    k = k.withColumn("aggregation", agg).filter(F.col("aggregation").isNotNull())
    reason = (F.when(F.col("col_role").isNull(), F.lit("column not found"))
              .when(F.col("is_sensitive"), F.lit("sensitive column"))
              .when(F.col("null_ratio_f") > MAX_NULL_RATIO_FOR_KPI, F.format_string(
                  "%.1f%% missing values", F.col("null_ratio_f") * 100)))
    fmt = F.coalesce(_map(ROLE_FORMAT)[F.col("col_role")], F.lit("number"))
    quality = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("missing_pct") * F.lit(1.5))
    return k.select(
        "dataset_id", F.concat(F.col("x_column"), F.lit("_"), F.col("aggregation")).alias("kpi"),
        F.col("x_column").alias("column"), "aggregation",
        kpi_title(F.col("x_column"), F.col("aggregation")).alias("title"), fmt.alias("format"),
        F.col("col_role").alias("semantic_role"), "priority", F.col("value").alias("relevance"),
        quality.alias("quality"), reason.alias("rejected_reason"), "seq", F.lit("universal").alias("source"))


def chart_candidates(intents: DataFrame, sem: DataFrame) -> DataFrame:
    """R10 (+ R14 chart checks): chart candidates with reject reasons."""
    xs = sem.select("dataset_id", F.col("column").alias("x_column"), F.col("semantic_role").alias("x_role"),
                    F.col("is_sensitive").alias("x_sensitive"), F.col("is_temporal").alias("x_temporal"),
                    F.coalesce(F.col("cardinality_count"), F.lit(0)).alias("x_card"),
                    F.coalesce(F.col("missing_pct"), F.lit(0.0)).alias("x_missing_pct"))
    ys = sem.select("dataset_id", F.col("column").alias("y_column"), F.col("semantic_role").alias("y_role2"))
    c = intents.filter(F.col("kind") == "chart").join(xs, ["dataset_id", "x_column"], "left") \
        .join(ys, ["dataset_id", "y_column"], "left")
    v = _valid_agg(F.col("y_role2"), F.col("aggregation"))
    v = F.when(v.isin("group_by", "trend", "date_grouping"), F.lit("count")).otherwise(v)
    agg = F.when(F.col("y_role2").isNotNull() & (F.col("aggregation") != "none"), v).otherwise(F.col("aggregation"))
    c = c.withColumn("aggregation", agg).filter(F.col("aggregation").isNotNull())
    ctype = F.col("chart_type")
    reason = (F.when(F.col("x_role").isNull(), F.lit("x column not found"))
              .when(F.col("x_sensitive"), F.lit("sensitive x column"))
              .when((ctype == "pie") & (F.col("x_card") > MAX_PIE_CATEGORIES),
                    F.format_string("pie with %d categories", F.col("x_card")))
              .when((ctype == "bar") & ~F.col("x_temporal") & (F.col("x_card") > MAX_CATEGORICAL_CARDINALITY),
                    F.format_string("bar with %d categories", F.col("x_card"))))
    quality = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("x_missing_pct") * F.lit(1.5))
    return c.select(
        "dataset_id", ctype.alias("chart_type"), F.col("x_column").alias("x_field"),
        F.coalesce(F.col("y_column"), F.lit("_count")).alias("y_field"), "aggregation",
        chart_title(F.col("type"), F.col("x_column"), F.col("y_column")).alias("title"),
        "x_role", F.col("y_role2").alias("y_role"), F.col("type").alias("intent_type"), "priority",
        F.col("value").alias("relevance"), quality.alias("quality"), reason.alias("rejected_reason"), "seq",
        F.lit("universal").alias("source"))


def _round(x: Column) -> Column:
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)) + F.lit(0.5)).cast("int")


def score_kpis(k: DataFrame) -> DataFrame:
    """R16 KPI score (weights .25/.20/.20/.15/.10/.05/.05)."""
    role = F.col("semantic_role")
    sem_v = F.coalesce(_map(ROLE_BUSINESS_VALUE)[role], F.lit(30))
    useful = F.when(F.col("priority") == "primary", F.lit(90)).otherwise(F.lit(65))
    total = (F.least(F.lit(100), F.coalesce(F.col("relevance"), F.lit(70))) * 0.25 + sem_v * 0.20 + useful * 0.20
             + _agg_fit(role, F.lower(F.col("aggregation"))) * 0.15 + F.col("quality") * 0.10 + useful * 0.05
             + F.lit(80) * 0.05)
    return k.withColumn("score", _round(total))


def score_charts(c: DataFrame) -> DataFrame:
    """R16 chart score."""
    is_count = (F.col("y_field") == "_count") | (F.col("aggregation") == "count")
    dom = F.when(F.col("priority") == "primary", F.lit(90)).otherwise(F.lit(65))
    xr = F.coalesce(_map(ROLE_BUSINESS_VALUE)[F.col("x_role")], F.lit(30))
    yr = F.when(is_count, F.lit(80)).otherwise(F.coalesce(_map(ROLE_BUSINESS_VALUE)[F.col("y_role")], F.lit(30)))
    useful = F.when(F.col("priority") == "primary", F.lit(88)).otherwise(F.lit(62))
    aggs = F.when(~is_count & F.col("y_role").isNotNull(),
                  _agg_fit(F.col("y_role"), F.lower(F.col("aggregation")))).otherwise(F.lit(80))
    total = (dom * 0.25 + (xr + yr) / 2 * 0.20 + useful * 0.20 + aggs * 0.15 + F.col("quality") * 0.10
             + _type_fit(F.col("chart_type"), F.col("x_role")) * 0.05 + F.lit(80) * 0.05)
    return c.withColumn("score", _round(total))


def _rank_order():
    return [F.desc("score"), F.when(F.col("priority") == "primary", 0).otherwise(1), F.asc("seq")]


def final_kpis(k: DataFrame) -> DataFrame:
    """R17 for KPIs: drop rejected, dedupe by (column, aggregation) and, where a
    KPI has one, its condition, keeping the best; keep the first 6 per dataset."""
    k = score_kpis(k).filter(F.col("rejected_reason").isNull())
    sig = F.concat_ws("::", F.lower(F.col("column")), F.lower(F.col("aggregation")),
                      *(["condition_test"] if "condition_test" in k.columns else []))
    w_sig = Window.partitionBy("dataset_id", sig).orderBy(*_rank_order())
    k = k.withColumn("_r", F.row_number().over(w_sig)).filter(F.col("_r") == 1).drop("_r")
    w = Window.partitionBy("dataset_id").orderBy(*_rank_order())
    return k.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= KPI_MAX)


def final_charts(c: DataFrame) -> DataFrame:
    """R17 for charts: drop rejected, dedupe by exact signature then by
    intent signature, then at most 6 primary and up to 3 secondary charts
    (6 in total) per dataset."""
    c = score_charts(c).filter(F.col("rejected_reason").isNull())
    x, y = F.lower(F.col("x_field")), F.regexp_replace(F.lower(F.col("y_field")), "_count", "count")
    agg, typ = F.lower(F.col("aggregation")), F.lower(F.col("chart_type"))
    exact = F.when(typ == "scatter", F.concat_ws("::", F.lit("scatter"), F.least(x, y), F.greatest(x, y), agg)) \
        .otherwise(F.concat_ws("::", typ, x, y, agg))
    intent = F.concat_ws("::", x, y, agg)
    for sig in (exact, intent):
        w_sig = Window.partitionBy("dataset_id", sig).orderBy(*_rank_order())
        c = c.withColumn("_r", F.row_number().over(w_sig)).filter(F.col("_r") == 1).drop("_r")
    prim = F.col("priority") == "primary"
    w_kind = Window.partitionBy("dataset_id", prim).orderBy(*_rank_order())
    c = c.withColumn("_k", F.row_number().over(w_kind)) \
        .withColumn("_np", F.least(F.count_if(prim).over(Window.partitionBy("dataset_id")), F.lit(PRIMARY_CHART_MAX)))
    keep = (prim & (F.col("_k") <= PRIMARY_CHART_MAX)) | \
        (~prim & (F.col("_k") <= F.least(F.lit(SECONDARY_CHART_MAX), F.lit(TOTAL_CHART_MAX) - F.col("_np"))))
    c = c.filter(keep).drop("_k", "_np")
    w = Window.partitionBy("dataset_id").orderBy(F.when(prim, 0).otherwise(1), *_rank_order())
    return c.withColumn("rank", F.row_number().over(w))
