"""From recommended specs to stored results: R17's tables of KPIs and charts are
compiled into one pass per dataset (``operators/dashboard``), and cards, points,
forecasts, alerts, filter options and insights are stored under S12."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard as DB
from ..operators import periods as PD
from ..operators import rules as RU
from ..operators import series as SR
from ..session import written
from ..sources.io import ResultStore
from ..sources.tables import table
from . import insights as IN
from .recommend import catalog as CT

#: datasets worked on at a time
JOBS = 4
TABLES = ("cards", "points", "forecasts", "alerts", "filters", "insights")


def kpi_specs(run: CT.Recommendation) -> DataFrame:
    """R17's KPIs with the aggregate that is executed (A31) and their condition."""
    kind = run.sem.select("dataset_id", "column", "type")
    k = run.kpis.join(kind, ["dataset_id", "column"], "left")
    for c, t in (("condition_test", "string"), ("condition_values", "array<string>"), ("is_share", "boolean")):
        if c not in k.columns:
            k = k.withColumn(c, F.lit(None).cast(t))
    return k.select("dataset_id", "rank", "kpi", "title", "format", "column", SR.choose_aggregate("kpi", "column", "type", "aggregation").alias("aggregation"),
                    "condition_test", "condition_values", "is_share")


def chart_specs(run: CT.Recommendation) -> DataFrame:
    """R17's charts after the rewrite of R21; any other aggregate counts rows."""
    c = run.charts.select("dataset_id", "rank", "chart_type", "x_field", "y_field", "aggregation", "title")
    c = CT.rewrite_specs(c, run.profile)
    agg = F.when(F.lower("aggregation").isin("sum", "avg", "min", "max", "none"), F.lower("aggregation")).otherwise(F.lit("count"))
    return c.select("dataset_id", "rank", "chart_type", "x_field", "y_field", agg.alias("aggregation"), F.coalesce("custom_title", "title").alias("title"))


class Plans:
    """The specs of the named datasets, as the compiler takes them.  They are
    bounded by R17's limits (six and six a dataset) and the column limit."""

    def __init__(self, run: CT.Recommendation, datasets: list[str]):
        mine = F.col("dataset_id").isin(datasets)
        self.kpis, self.charts, self.bounds, self.date, self.options = (defaultdict(list), defaultdict(list), defaultdict(dict), {}, defaultdict(list))
        for r in kpi_specs(run).filter(mine).orderBy("dataset_id", "rank").collect():
            condition = DB.Condition(r.column, r.condition_test, tuple(r.condition_values or ())) if r.condition_test else None
            over = DB.Measure() if r.is_share else None
            self.kpis[r.dataset_id].append(DB.Kpi(r.kpi, r.title, DB.Measure(r.column, r.aggregation, condition), over, r.format))
        for r in chart_specs(run).filter(mine).orderBy("dataset_id", "rank").collect():
            self.charts[r.dataset_id].append(DB.Chart(f"chart-{r['rank']}", r.title, r.chart_type, r.x_field, r.y_field or DB.ROWS, r.aggregation))
        columns = run.profile.filter(mine).select("dataset_id", "ordinal", "column", "kind", "type", "date_min", "date_max")
        for r in columns.filter("kind = 'date' or type in ('categorical', 'boolean')").orderBy("dataset_id", "ordinal").collect():
            if r.kind == "date":
                self.date.setdefault(r.dataset_id, r.column)
                if r.date_min is not None:
                    self.bounds[r.dataset_id][r.column] = (r.date_min, r.date_max)
            else:
                self.options[r.dataset_id].append(r.column)
        found = CT.kpi_mapping(run.profile.filter(mine)).filter(F.col("kpi").isin("expenses", "profit")).collect()
        self.mapped = {(r.dataset_id, r.kpi): r.column for r in found}

    def compiled(self, df: DataFrame, dataset: str, window: str | None = None, fresh: bool = True) -> DB.Dashboard:
        """``fresh``: the profile is of these very rows, so its dates are theirs."""
        rules = RU.default_rules(self.mapped.get((dataset, "expenses")), self.mapped.get((dataset, "profit")))
        return DB.compile_dashboard(df, self.kpis[dataset], self.charts[dataset], self.date.get(dataset), window,
                                    self.bounds[dataset] if fresh else None, rules=rules, options=self.options[dataset])


def results_of(d: DB.Dashboard, dataset: str) -> dict[str, DataFrame]:
    """The tables that are stored for a dataset."""
    cards = written(d.cards, "dashboard-cards")  # a few rows
    growth = PD.growth_card(cards.withColumn("ordinal", F.col("rank")).withColumn("label", F.col("title")))
    insights = IN.kpi_insights(cards, growth, d.alerts)
    tables = dict(zip(TABLES, (cards, d.points, d.forecasts, d.alerts, d.filters, insights)))
    return {name: t.withColumn("dataset_id", F.lit(dataset)) for name, t in tables.items()}


def store_dashboards(spark: SparkSession, base: str, run: CT.Recommendation, datasets: list[str], store: ResultStore, window: str | None = None) -> None:
    """Compute and store the dashboards of the named datasets, each dataset's tables
    switched at once."""
    plans = Plans(run, datasets)

    def one(dataset: str) -> None:
        store.put(results_of(plans.compiled(table(spark, base, dataset), dataset, window), dataset), [dataset])

    with ThreadPoolExecutor(JOBS) as pool:
        list(pool.map(one, datasets))
