"""Rule-text insights, recommendations and number display.

Insights are rows built with ``format_string``/``concat`` from the already
aggregated KPI cards, rule alerts and series summaries (small tables), so
they are ordinary DataFrame steps.  Only computed facts are emitted; when a
fact is missing, its insight is skipped (never a made-up number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import js_round

# Display symbols and insight texts.
CURRENCY_SYMBOL = "₹"
ABBREVIATIONS = [(1.0e9, "B"), (1.0e6, "M"), (1.0e3, "K")]
TEXT_GROWTH = "Overall growth trend is %s compared to the prior period."
TEXT_REVENUE = "Total revenue is %s across the active period."
TEXT_PROFIT = "Net profit stands at %s."
TEXT_ALERTS = "Rule engine detected %d operational alerts or anomalies."
TEXT_CLEAN = "All baseline validation checks passed. Data trends look stable."
TEXT_QUALITY = "Resolve missing cells in your dataset to increase insight accuracy."
TEXT_RULE = "Rule Triggered: %s matched %d rows."


def _plain(x: Column, digits: int) -> Column:
    """Number with up to ``digits`` decimals, halves away from zero, no
    trailing zeros, thousands grouping."""
    r = F.when(x >= 0, js_round(x, digits)).otherwise(-js_round(-x, digits))
    s = F.format_number(r, digits)
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_value(num, kind: str | Column = "number") -> Column:
    """K / M / B abbreviation with at most one decimal; currency gets
    the symbol; null/NaN -> '—'."""
    x = F.col(num) if isinstance(num, str) else num
    a = F.abs(x)
    val, suf = x, F.lit("")
    for limit, s in reversed(ABBREVIATIONS):
        val = F.when(a >= limit, x / F.lit(limit)).otherwise(val)
        suf = F.when(a >= limit, F.lit(s)).otherwise(suf)
    body = F.concat(_plain(val, 1), suf)
    k = F.lit(kind) if isinstance(kind, str) else kind
    out = F.when(k == "currency", F.concat(F.lit(CURRENCY_SYMBOL), body)).otherwise(body)
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(out)


def format_kpi(value, fmt: str | Column = "number") -> Column:
    """KPI card value: up to 2 decimals; currency symbol or percent sign."""
    x = F.col(value) if isinstance(value, str) else value
    body = _plain(x, 2)
    k = F.lit(fmt) if isinstance(fmt, str) else fmt
    return (F.when(k == "currency", F.concat(F.lit(CURRENCY_SYMBOL), body))
            .when(k == "percent", F.concat(body, F.lit("%"))).otherwise(body))


def kpi_insights(cards: DataFrame, growth: DataFrame, alerts: DataFrame) -> DataFrame:
    """G7 over KPI cards (kpi, value, format), the growth card and rule
    alerts: (id, category, severity, text)."""
    g = growth.select(F.lit("ins-growth").alias("id"), F.lit("growth").alias("category"),
                      F.when(F.col("value") >= 0, F.lit("success")).otherwise(F.lit("warning")).alias("severity"),
                      F.format_string(TEXT_GROWTH, F.format_string("%.1f%%", F.col("value"))).alias("text"))
    fmt = F.coalesce(F.col("format"), F.lit("number"))
    rev = cards.filter(F.col("kpi") == "revenue").select(
        F.lit("ins-revenue").alias("id"), F.lit("summary").alias("category"), F.lit("success").alias("severity"),
        F.format_string(TEXT_REVENUE, format_kpi("value", fmt)).alias("text"))
    prof = cards.filter(F.col("kpi") == "profit").select(
        F.lit("ins-profit").alias("id"), F.lit("performance").alias("category"), F.lit("info").alias("severity"),
        F.format_string(TEXT_PROFIT, format_kpi("value", fmt)).alias("text"))
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("n"))
    al = n_alerts.select(
        F.when(F.col("n") > 0, F.lit("ins-anomalies")).otherwise(F.lit("ins-clean")).alias("id"),
        F.when(F.col("n") > 0, F.lit("alert")).otherwise(F.lit("summary")).alias("category"),
        F.when(F.col("n") > 0, F.lit("warning")).otherwise(F.lit("success")).alias("severity"),
        F.when(F.col("n") > 0, F.format_string(TEXT_ALERTS, F.col("n"))).otherwise(F.lit(TEXT_CLEAN)).alias("text"))
    return g.unionByName(rev).unionByName(prof).unionByName(al)


def recommendations(problem_count: Column, alerts: DataFrame) -> DataFrame:
    """Quality recommendation when problems exist, then one per alert."""
    spark = alerts.sparkSession
    q = spark.range(1).select(F.lit("quality").alias("type"), F.lit(TEXT_QUALITY).alias("message")) \
        .filter(problem_count > 0)
    a = alerts.select(F.col("severity").alias("type"),
                      F.format_string(TEXT_RULE, F.col("label"), F.col("triggered_count")).alias("message"))
    return q.unionByName(a)


def series_insights(summary: DataFrame, y_name: str = "Record Count", x_is_region: bool = False) -> DataFrame:
    """G7 bullets over a series summary (A26 output, one row)."""
    s = summary
    b = []
    b.append(s.filter(F.abs(F.col("growth_pct")) > 1).select(F.format_string(
        "%s %s %s%% across the dataset timeline.", F.lit(y_name),
        F.when(F.col("growth_pct") > 0, F.lit("increased")).otherwise(F.lit("decreased")),
        F.format_string("%.1f", F.abs(F.col("growth_pct")))).alias("text")))
    b.append(s.filter(F.col("highest_x").isNotNull()).select(F.format_string(
        'Highest value recorded at "%s" with a total of %s.', F.col("highest_x"),
        _plain(F.col("highest_y"), 3)).alias("text")))
    b.append(s.filter(F.col("highest_is_notable")).select(F.format_string(
        '"%s" contributes a significant %s%% of the total aggregate.', F.col("highest_x"),
        F.format_string("%.0f", F.col("highest_share_pct"))).alias("text")))
    if x_is_region:
        b.append(s.filter(F.col("highest_x").isNotNull()).select(F.format_string(
            'Geography report shows "%s" region is the top performer.', F.col("highest_x")).alias("text")))
    b.append(s.filter(F.col("outliers") > 0).select(F.format_string(
        "Identified %d statistical outliers.", F.col("outliers")).alias("text")))
    out = b[0]
    for x in b[1:]:
        out = out.unionByName(x)
    return out
