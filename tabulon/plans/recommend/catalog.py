"""Catalog-wide recommendation jobs (R1-R23) over the column profiles of
every dataset.

``column_profile`` profiles each dataset in a P1 job of its own and writes the
(small) result once to the shared checkpoint folder, so all later steps read
a written table instead of re-running the profile, and a lost executor
never forces a recompute of the scans.  Everything after that is joins on
``dataset_id`` and windows partitioned by it.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import profile as PF
from ...session import ensure_checkpoint_dir
from ...sources.tables import table
from . import candidates as C
from . import domain as D
from . import semantics as S

PROFILE_COLUMNS = ["dataset_id", "ordinal", "column", "kind", "type", "detected_type", "fine_type", "strict_type",
                   "metadata_type", "null_ratio", "unique_ratio", "cardinality_count", "cardinality_class",
                   "missing_pct", "distinct_raw", "rows", "non_empty", "n_email", "n_phone", "n_url", "len_sum", "date_min", "date_max"]
# KPI synonyms, question words and suggested questions.
KPI_SYNONYMS = {
    "revenue": ["revenue", "sales_amount", "sales", "total", "amount"],
    "sales": ["quantity", "units_sold", "units", "qty"],
    "customers": ["customer_id", "email", "customer_name", "client_id"],
    "expenses": ["expense", "expenses", "cost", "cogs"],
    "profit": ["profit", "margin", "net_income"],
    "date": ["date", "created_at", "timestamp", "time"],
}
CURRENCY_KPIS = ["revenue", "expenses", "profit"]
COMPARE_WORDS_RE = r"(?i)month|year|trend|drop|fall|increase|period|over time|time"
TOP_WORDS_RE = r"(?i)top|best|highest|worst|bottom|lowest|first"
ASC_WORDS_RE = r"(?i)worst|bottom|lowest"
LIMIT_RE = r"\b([1-9]|10)\b"
AGG_WORDS = [("avg", r"(?i)avg|average|mean"), ("min", r"(?i)min|minimum|least"),
             ("max", r"(?i)max|maximum|most"), ("count", r"(?i)count|number of|how many")]
DATE_NAME_RE = r"(?i)date|time|day|month|year|timestamp|created_at|updated_at|period"
SUGGESTED_QUESTIONS = ["Which %s performs best?", "Show %s by %s.", "Why did %s drop?", "What are the top 5 %s?"]
#: profile jobs that run at a time
PROFILE_JOBS = 4


def column_profile(spark: SparkSession, base: str, tables) -> DataFrame:
    """Profile every dataset in a job of its own, so that no plan grows with
    the number of datasets, into one table partitioned by dataset_id."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"

    def one(t: str) -> T.StructType:
        p = PF.profile(table(spark, base, t), with_samples=False).select(*[c for c in PROFILE_COLUMNS if c != "dataset_id"])
        p.coalesce(1).write.parquet(f"{folder}/dataset_id={t}")  # one row per column
        return p.schema

    with ThreadPoolExecutor(PROFILE_JOBS) as pool:
        schemas = list(pool.map(one, tables))
    schema = T.StructType([*schemas[0].fields, T.StructField("dataset_id", T.StringType())])
    return spark.read.schema(schema).option("basePath", folder).parquet(folder).select(*PROFILE_COLUMNS)


def datasets_of(profile: DataFrame) -> DataFrame:
    return profile.select("dataset_id", F.concat(F.col("dataset_id"), F.lit(".parquet")).alias("file_name")) \
        .distinct()


class Recommendation:
    """The tables of one run of R1-R17 over a profile table, each written
    when first asked for.  It knows nothing but the profile it was given:
    after the data has changed, make a new profile and a new run."""

    def __init__(self, profile: DataFrame, with_domain: bool = True):
        self.profile, self.with_domain = profile, with_domain

    @cached_property
    def sem(self) -> DataFrame:
        """R1 + R2."""
        return S.materialize(S.classify(self.profile))

    @cached_property
    def relationships(self) -> DataFrame:
        return S.materialize(S.relationships(self.sem))

    @cached_property
    def intents(self) -> DataFrame:
        return S.materialize(S.intents(self.relationships, self.sem))

    @cached_property
    def domains(self) -> DataFrame:
        return S.materialize(D.classify_domains(self.profile.select("dataset_id", "column"), datasets_of(self.profile)))

    @cached_property
    def kpi_candidates(self) -> DataFrame:
        return S.materialize(C.kpi_candidates(self.intents, self.sem))

    @cached_property
    def chart_candidates(self) -> DataFrame:
        return S.materialize(C.chart_candidates(self.intents, self.sem))

    @cached_property
    def kpis(self) -> DataFrame:
        kc = self.kpi_candidates
        if self.with_domain:
            dk = D.domain_kpi_candidates(self.sem, self.domains)
            kc = S.materialize(kc.unionByName(_checked_domain_kpis(dedupe_domain_kpis(kc, dk), self.sem), allowMissingColumns=True))
        return S.materialize(C.final_kpis(kc))

    @cached_property
    def charts(self) -> DataFrame:
        cc = self.chart_candidates
        if self.with_domain:
            dc = D.domain_chart_candidates(self.sem, self.domains)
            cc = S.materialize(cc.unionByName(_checked_domain_charts(dc, cc, self.sem), allowMissingColumns=True))
        return S.materialize(C.final_charts(cc))


def recommend(profile: DataFrame, with_domain: bool = True):
    """R1-R17 end to end -> (final KPI table, final chart table)."""
    run = Recommendation(profile, with_domain)
    return run.kpis, run.charts


def _checked_domain_kpis(dk: DataFrame, sem: DataFrame) -> DataFrame:
    """Domain KPI supplements: only (column, aggregation) pairs the universal
    list lacks; same R14 checks."""
    s = sem.select("dataset_id", "column", "is_sensitive", "null_ratio_f",
                   F.coalesce(F.col("missing_pct"), F.lit(0.0)).alias("missing_pct"))
    k = dk.join(s, ["dataset_id", "column"], "left")
    # where a KPI counts the rows that have a value, a missing one is an answer
    counts_present = F.coalesce(F.col("condition_test") == "present", F.lit(False))
    reason = (F.when(F.col("is_sensitive"), F.lit("sensitive column"))
              .when((F.col("null_ratio_f") > C.MAX_NULL_RATIO_FOR_KPI) & ~counts_present,
                    F.format_string("%.1f%% missing values", F.col("null_ratio_f") * 100)))
    missing = F.when(counts_present, F.lit(0.0)).otherwise(F.col("missing_pct"))
    quality = F.greatest(F.lit(0.0), F.lit(100.0) - missing * F.lit(1.5))
    return k.select("dataset_id", "kpi", "column", "aggregation", "title", "format", "semantic_role", "priority",
                    "relevance", quality.alias("quality"), reason.alias("rejected_reason"), "seq", "source",
                    "condition_test", "condition_values", "is_share")


def _checked_domain_charts(dc: DataFrame, universal: DataFrame, sem: DataFrame) -> DataFrame:
    keys = ["dataset_id", "x_field", "y_field", "aggregation"]
    sup = dc.join(universal.select(*keys).distinct(), keys, "left_anti")
    xs = sem.select("dataset_id", F.col("column").alias("x_field"), F.col("is_sensitive").alias("xs"),
                    F.col("is_temporal").alias("xt"), F.coalesce(F.col("cardinality_count"), F.lit(0)).alias("xc"),
                    F.coalesce(F.col("missing_pct"), F.lit(0.0)).alias("xm"))
    c = sup.join(xs, ["dataset_id", "x_field"], "left")
    t = F.col("chart_type")
    reason = (F.when(F.col("xs"), F.lit("sensitive x column"))
              .when((t == "pie") & (F.col("xc") > C.MAX_PIE_CATEGORIES), F.format_string("pie with %d categories",
                                                                                         F.col("xc")))
              .when((t == "bar") & ~F.col("xt") & (F.col("xc") > C.MAX_CATEGORICAL_CARDINALITY),
                    F.format_string("bar with %d categories", F.col("xc"))))
    quality = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("xm") * F.lit(1.5))
    return c.select("dataset_id", "chart_type", "x_field", "y_field", "aggregation", "title", "x_role", "y_role",
                    "intent_type", "priority", F.lit(None).cast("int").alias("relevance"), quality.alias("quality"),
                    reason.alias("rejected_reason"), "seq", "source")


def dedupe_domain_kpis(kc: DataFrame, dk: DataFrame) -> DataFrame:
    """R17 merge rule: domain KPIs whose (column, aggregation) is already a
    universal candidate are skipped (anti join); one with a condition is another
    KPI than the plain one."""
    keys = ["dataset_id", "column", "aggregation"]
    plain = dk.filter(F.col("condition_test").isNull()).join(kc.select(*keys).distinct(), keys, "left_anti")
    return plain.unionByName(dk.filter(F.col("condition_test").isNotNull()))


# ------------------------------------------------------------------ R13

def validate_external_kpis(specs: DataFrame, sem: DataFrame) -> DataFrame:
    """Externally proposed (dataset_id, column, aggregation) KPI specs:
    unknown columns (anti join), roles excluded from KPIs, invalid
    aggregations are rejected with a reason; accepted ones get their role."""
    rules = S.aggregation_rules(specs.sparkSession)
    j = specs.join(sem.select("dataset_id", "column", "semantic_role"), ["dataset_id", "column"], "left")
    v = S.validate_aggregation(j.withColumn("aggregation", S.normalize_aggregation(F.col("aggregation"))),
                               rules, "semantic_role", "aggregation")
    reason = (F.when(F.col("semantic_role").isNull(), F.lit("no such column"))
              .when(F.col("semantic_role").isin(S.KPI_EXCLUDED_ROLES),
                    F.format_string("columns of the role %s make no KPI", F.col("semantic_role")))
              .when(~F.col("valid"), F.col("reason")))
    return v.select(*specs.columns, "semantic_role", reason.isNull().alias("accepted"),
                    reason.alias("rejected_reason"))


# ------------------------------------------------------------------ R18

def _first(cond: Column, what: str = "column") -> Column:
    return F.min(F.when(cond, F.struct(F.col("ordinal"), F.col(what).alias("v")))).getField("v")


def _name_has(words: list[str]) -> Column:
    low = F.lower(F.col("column"))
    out = None
    for w in words:
        c = low.contains(w)
        out = c if out is None else out | c
    return out


def best_chart(profile: DataFrame) -> DataFrame:
    """One chart per dataset from 12 ordered rules (first match wins)
    over the fine types (P11) and column names."""
    ft = F.col("fine_type")
    num = ft.isin("Numeric", "Integer", "Float", "Currency", "Percentage")
    rank_num = F.row_number().over(Window.partitionBy("dataset_id", num).orderBy("ordinal"))
    p = profile.withColumn("num_rank", F.when(num, rank_num))
    a = p.groupBy("dataset_id").agg(
        _first(_name_has(["revenue", "sales_amount", "amount", "income", "turnover", "gross_sales"])).alias("rev"),
        _first(_name_has(["month", "period"])).alias("month"),
        _first(_name_has(["year"])).alias("year"),
        _first(_name_has(["product", "item", "sku"])).alias("product"),
        _first(_name_has(["region", "country", "state", "city", "zone"])).alias("region"),
        _first(_name_has(["sales", "units_sold", "units", "qty", "quantity", "sales_count", "transactions",
                          "volume"])).alias("sales"),
        _first(ft == "Date").alias("date1"),
        _first(F.col("num_rank") == 1).alias("num1"),
        _first(F.col("num_rank") == 2).alias("num2"),
        F.count_if(num).alias("n_num"),
        _first(ft == "Percentage").alias("pct1"),
        _first(ft == "Category").alias("cat1"),
        _first(ft == "Category", "distinct_raw").alias("cat1_distinct"),
        _first(ft == "Text").alias("text1"),
    )
    metric = F.coalesce("sales", "rev", "num1")
    rules = [
        (F.col("month").isNotNull() & F.col("rev").isNotNull(), "area", 99, "month", F.col("rev"), "sum"),
        (F.col("year").isNotNull() & F.coalesce("rev", "sales", "num1").isNotNull(), "line", 98, "year",
         F.coalesce("rev", "sales", "num1"), "sum"),
        (F.col("product").isNotNull() & metric.isNotNull(), "horizontal-bar", 97, "product", metric, "sum"),
        (F.col("region").isNotNull() & metric.isNotNull(), "pie", 96, "region", metric, "sum"),
        (F.col("date1").isNotNull() & (F.col("n_num") > 0), "line", 95, "date1", F.col("num1"), "sum"),
        (F.col("n_num") >= 2, "scatter", 92, "num1", F.col("num2"), "none"),
        (F.col("cat1").isNotNull() & F.col("pct1").isNotNull(), "pie", 90, "cat1", F.col("pct1"), "avg"),
        (F.col("cat1").isNotNull() & (F.col("n_num") > 0) & (F.col("cat1_distinct") > 8), "horizontal-bar", 88,
         "cat1", F.col("num1"), "sum"),
        (F.col("cat1").isNotNull() & (F.col("n_num") > 0), "bar", 94, "cat1", F.col("num1"), "sum"),
        (F.col("n_num") == 1, "histogram", 85, "num1", F.lit("_count"), "count"),
        (F.col("cat1").isNotNull(), "bar", 75, "cat1", F.lit("_count"), "count"),
        (F.col("text1").isNotNull(), "bar", 60, "text1", F.lit("_count"), "count"),
    ]
    out = None
    for cond, ctype, conf, x, y, agg in rules:
        s = F.struct(F.lit(ctype).alias("chart_type"), F.lit(conf).alias("confidence"), F.col(x).alias("x_field"),
                     y.cast("string").alias("y_field"), F.lit(agg).alias("aggregation"))
        out = F.when(cond, s) if out is None else out.when(cond, s)
    none = F.struct(F.lit("none").alias("chart_type"), F.lit(0).alias("confidence"),
                    F.lit(None).cast("string").alias("x_field"), F.lit(None).cast("string").alias("y_field"),
                    F.lit(None).cast("string").alias("aggregation"))
    return a.select("dataset_id", out.otherwise(none).alias("c")).select("dataset_id", "c.*")


# ------------------------------------------------------------------ R19

def kpi_mapping(profile: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """KPI key -> column per dataset: an explicit override wins, else
    the first synonym (list order) that a column name equals or contains
    (column order on ties).  Output (dataset_id, kpi, column, source, label,
    format, error)."""
    spark = profile.sparkSession
    low = F.lower(F.col("column"))
    cols = profile.select("dataset_id", "ordinal", "column")
    # the synonym list is fixed: one ``contains`` test per synonym, no join
    tests = F.filter(F.array(*[F.when(low.contains(w), F.struct(F.lit(k).alias("kpi"), F.lit(i).alias("syn_order")))
                               for k, ws in KPI_SYNONYMS.items() for i, w in enumerate(ws)]),
                     lambda x: x.isNotNull())
    hits = cols.select("dataset_id", "ordinal", "column", F.explode(tests).alias("h")).select(
        "dataset_id", "ordinal", "column", "h.kpi", "h.syn_order")
    w = Window.partitionBy("dataset_id", "kpi").orderBy("syn_order", "ordinal")
    auto = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1) \
        .select("dataset_id", "kpi", F.col("column").alias("auto_column"))
    if overrides is None:
        overrides = spark.createDataFrame([], "dataset_id string, kpi string, column string")
    ov = overrides.withColumnRenamed("column", "override_column")
    known = cols.select("dataset_id", F.col("column").alias("override_column"), F.lit(True).alias("_known"))
    ov = ov.join(known, ["dataset_id", "override_column"], "left")
    allk = auto.select("dataset_id", "kpi").unionByName(ov.select("dataset_id", "kpi")).distinct()
    m = allk.join(auto, ["dataset_id", "kpi"], "left").join(ov, ["dataset_id", "kpi"], "left")
    good_ov = F.col("override_column").isNotNull() & F.coalesce(F.col("_known"), F.lit(False))
    col = F.when(good_ov, F.col("override_column")).otherwise(F.col("auto_column"))
    label = F.concat(F.upper(F.substring("kpi", 1, 1)), F.regexp_replace(F.expr("substring(kpi, 2)"), "_", " "))
    err = F.when(F.col("override_column").isNotNull() & ~F.coalesce(F.col("_known"), F.lit(False)),
                 F.format_string("the dataset has no column %s for the KPI %s",
                                 F.col("override_column"), F.col("kpi")))
    return m.select("dataset_id", "kpi", col.alias("column"),
                    F.when(good_ov, F.lit("override")).otherwise(F.lit("synonym")).alias("source"),
                    label.alias("label"),
                    F.when(F.lower("kpi").isin(CURRENCY_KPIS), F.lit("currency")).otherwise(F.lit("number"))
                    .alias("format"), err.alias("error"))


# ------------------------------------------------------------------ R20

def _reference_type(profile: DataFrame) -> Column:
    """number / string / boolean / date as the ask feature sees columns."""
    st = F.col("strict_type")
    return F.when(F.col("kind") == "number", F.lit("number")).when(F.col("kind") == "date", F.lit("date")) \
        .when(F.col("kind") == "boolean", F.lit("boolean")).otherwise(st)


def route_questions(questions: DataFrame, profile: DataFrame) -> DataFrame:
    """Route each question (dataset_id, question_id, question) to an
    analysis operation by word rules; the column a question names (else the
    first of its type) becomes metric / group / date.

    A dataset's columns travel as one array, so a question stays one row, and
    the join splits a dataset that has very many questions (AQE)."""
    cols = profile.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", F.col("column").alias("c"), _reference_type(profile).alias("rtype")))).alias("_cols"))  # <= MAX_COLUMNS
    q = questions.join(cols, "dataset_id", "left")
    low = F.lower(F.col("question"))

    def pick(kinds):
        of = F.filter("_cols", lambda x: x["rtype"].isin(kinds))
        named = F.filter(of, lambda x: F.contains(low, F.lower(x["c"])))
        return F.coalesce(F.get(named, F.lit(0)), F.get(of, F.lit(0)))["c"]
    g = q.select("dataset_id", "question_id", "question", pick(["number"]).alias("metric"),
                 pick(["string", "boolean"]).alias("group_by"), pick(["date"]).alias("date_column"))
    ql = F.col("question")
    cmp = F.col("date_column").isNotNull() & ql.rlike(COMPARE_WORDS_RE)
    top = ql.rlike(TOP_WORDS_RE)
    lim = F.coalesce(F.nullif(F.regexp_extract(F.lower(ql), LIMIT_RE, 1), F.lit("")).cast("int"), F.lit(5))
    agg = F.lit("sum")
    for name, rx in AGG_WORDS:
        agg = F.when(ql.rlike(rx), F.lit(name)).otherwise(agg)
    action = F.when(cmp, F.lit("compare_periods")).when(top, F.lit("top_n")).otherwise(F.lit("group_by"))
    return g.select(
        "dataset_id", "question_id", action.alias("action"), "metric",
        F.when(~cmp, F.col("group_by")).alias("group_by"), F.when(cmp, F.col("date_column")).alias("date_column"),
        F.when(cmp, F.lit("monthly")).alias("period_type"), F.when(~cmp & top, lim).alias("limit"),
        F.when(~cmp & top, F.when(ql.rlike(ASC_WORDS_RE), F.lit("asc")).otherwise(F.lit("desc"))).alias("direction"),
        F.when(~cmp & ~top, agg).alias("aggregation"))


# ------------------------------------------------------------------ R21, R22

def rewrite_specs(specs: DataFrame, profile: DataFrame) -> DataFrame:
    """Average quantity by order id becomes average quantity per
    customer (first column named like customer), with its own title."""
    cust = profile.filter(F.col("column").rlike("(?i)customer_id|customer|cust")) \
        .groupBy("dataset_id").agg(F.min(F.struct("ordinal", "column")).getField("column").alias("cust"))
    j = specs.join(cust, "dataset_id", "left")
    hit = (F.lower(F.col("x_field")) == "order_id") & (F.lower(F.col("y_field")) == "quantity") & \
        (F.lower(F.col("aggregation")) == "avg") & F.col("cust").isNotNull()
    return j.select(*[F.when(hit, F.col("cust")).otherwise(F.col(c)).alias(c) if c == "x_field" else F.col(c)
                      for c in specs.columns],
                    F.when(hit, F.lit("Average quantity per customer")).alias("custom_title"))


def series_kind(specs: DataFrame, sem: DataFrame) -> DataFrame:
    """Scatter when the aggregation is none; temporal when x is a
    typed/parsed date, has the temporal role, or its name holds a date word;
    else category.  (Charts over a column that does not parse as a date have
    no buckets; ``temporal_series`` drops such values.)"""
    x = sem.select("dataset_id", F.col("column").alias("x_field"), F.col("type").alias("x_type"),
                   F.col("semantic_role").alias("x_role"))
    j = specs.join(x, ["dataset_id", "x_field"], "left")
    temporal = (F.col("x_type") == "date") | (F.col("x_role") == S.TEMPORAL) | \
        (F.col("x_type").isNotNull() & F.col("x_field").rlike(DATE_NAME_RE))
    kind = F.when(F.lower(F.col("aggregation")) == "none", F.lit("scatter")) \
        .when(temporal, F.lit("temporal")).otherwise(F.lit("category"))
    return j.select(*specs.columns, kind.alias("series_kind"))


# ------------------------------------------------------------------ R23

def suggested_questions(profile: DataFrame) -> DataFrame:
    """Four suggested questions per dataset from its first metric,
    first two categories and first date column."""
    rt = _reference_type(profile)
    p = profile.withColumn("rtype", rt)
    cat_rank = F.row_number().over(Window.partitionBy("dataset_id", F.col("rtype").isin("string", "boolean"))
                                   .orderBy("ordinal"))
    p = p.withColumn("cat_rank", F.when(F.col("rtype").isin("string", "boolean"), cat_rank))
    a = p.groupBy("dataset_id").agg(
        _first(F.col("rtype") == "number").alias("m"), _first(F.col("cat_rank") == 1).alias("c1"),
        _first(F.col("cat_rank") == 2).alias("c2"), _first(F.col("rtype") == "date").alias("d"))
    m = F.coalesce("m", F.lit("sales"))
    c1 = F.coalesce("c1", F.lit("region"))
    c2 = F.coalesce("c2", "c1", F.lit("products"))
    d = F.coalesce("d", F.lit("month"))
    qs = F.array(F.format_string(SUGGESTED_QUESTIONS[0], c1), F.format_string(SUGGESTED_QUESTIONS[1], m, d),
                 F.format_string(SUGGESTED_QUESTIONS[2], m), F.format_string(SUGGESTED_QUESTIONS[3], c2))
    return a.select("dataset_id", F.posexplode(qs).alias("position", "question"))
