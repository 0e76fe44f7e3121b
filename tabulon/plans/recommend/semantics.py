"""Semantic roles, column flags, aggregation rules, column relationships,
capabilities and analytical intents (R1, R2, R4, R6, R7, R8, W4).

Input is a column profile table with one row per (dataset_id, column):
``dataset_id, ordinal, column, type, null_ratio, unique_ratio,
cardinality_count, cardinality_class`` (see ``catalog.column_profile``).  The
whole catalog is processed at once: every rule is a ``when``/``rlike`` Column,
pairs of columns come from an equi-join on ``dataset_id`` (bounded by the
column limit of a dataset), and every ranking is a window partitioned by
``dataset_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Name patterns of the semantic roles (case-insensitive, tested
# against the lower-cased name with blanks turned into '_').
# ---------------------------------------------------------------------------
IDENTIFIER_PATTERNS = [
    r"^(.*_)?id$", r"^id[_-]", r"_id$", r"^(uuid|guid)$",
    r"^(employee|emp|customer|cust|order|order_no|invoice|txn|transaction|ticket|case|sku|product|item|ref|reference|record|row|serial|number|num)_?(id|no|num|number|code|key)$",
    r"^(code|key)$", r"^(barcode|ean|upc)$",
]
MONETARY_PATTERNS = [
    r"revenue", r"sales", r"income", r"turnover", r"gmv",
    r"profit", r"margin", r"earnings", r"ebit", r"ebitda",
    r"expense", r"cost", r"spend", r"expenditure", r"overhead", r"outflow",
    r"budget", r"actual", r"forecast", r"target",
    r"salary", r"wage", r"compensation", r"pay(?:ment|roll)?$", r"remuneration", r"ctc",
    r"amount", r"value", r"price", r"fee", r"charge", r"rate(?!ing)",
    r"inr$", r"usd$", r"eur$", r"gbp$", r"cad$", r"aud$",
    r"cash", r"balance", r"debit", r"credit", r"invoice",
    r"discount(?!_pct|_rate|_percent)", r"rebate", r"commission",
    r"total(?!_count|_records)", r"net(?!_count)", r"gross",
]
PERCENTAGE_PATTERNS = [
    r"pct$", r"percent$", r"percentage$", r"_pct_?$", r"_percent_?$",
    r"\bpct\b", r"\bpercent\b",
    r"rate$", r"ratio$",
    r"attendance",
    r"utilization", r"occupancy", r"capacity_utilization",
    r"fill_rate", r"hit_rate", r"conversion_rate", r"open_rate", r"click_rate",
    r"churn_rate", r"retention_rate", r"win_rate", r"pass_rate", r"success_rate",
    r"completion_rate", r"response_rate", r"acceptance_rate",
    r"margin_pct", r"growth_rate",
]
ORDINAL_PATTERNS = [
    r"rating", r"score", r"rank", r"grade",
    r"performance",
    r"satisfaction", r"csat", r"nps", r"star",
    r"level", r"tier", r"priority", r"severity",
    r"gpa", r"band",
]
DEMOGRAPHIC_PATTERNS = [
    r"^age$", r"age_?(?:years|at|group|range|band)?$",
    r"^gender$", r"^sex$",
    r"year_?of_?birth", r"birth_?year", r"dob", r"date_of_birth",
    r"experience(?:_years)?$", r"tenure$", r"years?_?(?:of_?)?experience",
    r"seniority",
]
GEOGRAPHIC_PATTERNS = [
    r"country", r"nation",
    r"state", r"province", r"region", r"territory", r"zone",
    r"city", r"town", r"district", r"county", r"municipality",
    r"location", r"address", r"street", r"zip", r"postal", r"pin(?:code)?",
    r"branch", r"plant", r"warehouse", r"site",
]
STATUS_PATTERNS = [
    r"^status$", r"^state$",
    r"^is_", r"^has_", r"^was_",
    r"employment_?status", r"job_?status", r"active$", r"inactive$",
    r"flagged", r"enabled", r"verified", r"approved",
    r"exit_?type", r"exit_?reason", r"attrition_?reason",
    r"termination_?reason",
]
CONTACT_PATTERNS = [
    r"email", r"e_?mail",
    r"phone", r"mobile", r"contact", r"tel(?:ephone)?", r"fax",
    r"url", r"website", r"link", r"href",
]
SENSITIVE_PATTERNS = [
    r"ssn", r"social_security", r"passport", r"national_id", r"aadhar", r"pan_no",
    r"driving_license", r"ip_address", r"device_id",
    r"^(first_?name|last_?name|full_?name|name)$",
]
TEMPORAL_PATTERNS = [
    r"date", r"time", r"timestamp", r"datetime",
    r"year$", r"month$", r"quarter$", r"week$", r"day$",
    r"period", r"fiscal", r"created_?at", r"updated_?at", r"modified",
    r"join(?:ing)?_?date", r"hire_?date", r"start_?date", r"end_?date",
    r"exit_?date", r"termination_?date", r"resignation_?date",
    r"order_?date", r"invoice_?date", r"due_?date", r"delivery_?date",
    r"birth_?date",
]
ADDITIVE_PATTERNS = [
    r"count$", r"quantity", r"qty", r"units?$", r"volume",
    r"headcount", r"transactions?", r"orders?$", r"calls?$", r"tickets?$",
    r"sessions?", r"views?$", r"clicks?$", r"impressions?$", r"conversions?$",
    r"downloads?$", r"installs?$", r"signups?$",
    r"hours?$", r"days?_?worked$", r"overtime",
    r"defects?$", r"issues?$", r"errors?$", r"incidents?$",
    r"production$", r"output$", r"units?_?produced", r"batch(?:es)?$",
    r"shipments?$", r"deliveries$", r"packages?$",
]
RATIO_PATTERNS = [r"ratio", r"index"]

# Semantic role names.
IDENTIFIER = "identifier"
MONETARY = "monetary_metric"
ADDITIVE = "additive_metric"
NON_ADDITIVE = "non_additive_metric"
PERCENTAGE = "percentage_metric"
RATIO = "ratio_metric"
ORDINAL = "ordinal_metric"
DEMOGRAPHIC = "demographic_attribute"
CATEGORICAL = "categorical_dimension"
GEOGRAPHIC = "geographic_dimension"
TEMPORAL = "temporal_dimension"
STATUS = "status_dimension"
TEXT = "text_attribute"
CONTACT = "contact_information"
SENSITIVE = "sensitive_attribute"
UNKNOWN = "unknown"

# Aggregation rules per role (allowed, preferred, forbidden, default).
AGGREGATION_RULES = {
    MONETARY: (["sum", "avg", "median", "min", "max"], ["sum", "avg"], [], "sum"),
    ADDITIVE: (["sum", "avg", "median", "min", "max", "count"], ["sum", "avg"], [], "sum"),
    PERCENTAGE: (["avg", "median", "min", "max"], ["avg"], ["sum"], "avg"),
    ORDINAL: (["avg", "median", "min", "max", "distribution", "count"], ["avg", "distribution"], ["sum"], "avg"),
    RATIO: (["avg", "median", "min", "max"], ["avg"], ["sum"], "avg"),
    DEMOGRAPHIC: (["avg", "median", "min", "max", "distribution"], ["avg", "distribution"], ["sum"], "avg"),
    NON_ADDITIVE: (["avg", "median", "min", "max", "distribution"], ["avg"], ["sum"], "avg"),
    IDENTIFIER: (["count", "count_distinct", "distinct"], ["count_distinct"],
                 ["sum", "avg", "median", "min", "max"], "count_distinct"),
    CATEGORICAL: (["count", "count_distinct", "group_by", "percentage_distribution"], ["group_by", "count"],
                  ["sum", "avg", "median"], "group_by"),
    GEOGRAPHIC: (["count", "count_distinct", "group_by", "percentage_distribution"], ["group_by", "count"],
                 ["sum", "avg", "median"], "group_by"),
    STATUS: (["count", "percentage_distribution", "group_by"], ["count", "percentage_distribution"],
             ["sum", "avg", "median"], "count"),
    TEMPORAL: (["min", "max", "date_grouping", "trend", "count"], ["trend", "date_grouping"], ["sum", "avg"], "trend"),
    TEXT: (["count", "count_distinct"], ["count"], ["sum", "avg", "median"], "count"),
    CONTACT: ([], [], ["sum", "avg", "count", "count_distinct"], None),
    SENSITIVE: (["count"], [], ["sum", "avg", "median"], "count"),
    UNKNOWN: (["count"], ["count"], ["sum", "avg"], "count"),
}
AGGREGATION_SYNONYMS = {
    "distinct": "count_distinct", "count distinct": "count_distinct", "countdistinct": "count_distinct",
    "average": "avg", "mean": "avg", "total": "sum", "percent distribution": "percentage_distribution",
}
KPI_EXCLUDED_ROLES = [IDENTIFIER, CATEGORICAL, GEOGRAPHIC, TEXT, CONTACT, SENSITIVE, TEMPORAL, STATUS, UNKNOWN]

# Base KPI value by role, relationship and capability scores.
KPI_ROLE_VALUE = {MONETARY: 95, ADDITIVE: 85, PERCENTAGE: 75, ORDINAL: 72, RATIO: 70,
                  DEMOGRAPHIC: 65, NON_ADDITIVE: 60, UNKNOWN: 40}
INTENT_CAPS = {"time_series": 4, "breakdown": 5, "frequency": 3, "proportion": 2, "correlation": 2}


def any_pattern(name: Column, patterns: list[str]) -> Column:
    """True when any of the patterns is found in the name (case-insensitive)."""
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def normalized_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"\s+", "_")


def physical_type(t: Column) -> Column:
    t = F.lower(F.coalesce(t, F.lit("")))
    return (F.when(t.isin("date", "datetime", "timestamp"), F.lit("date"))
            .when(t.isin("boolean", "bool"), F.lit("boolean"))
            .when(t.isin("currency", "percentage", "numeric", "number", "integer", "float"), F.lit("number"))
            .otherwise(F.lit("string")))


def classify(profile: DataFrame) -> DataFrame:
    """R1 + R2: semantic role, confidence and analytical flags per column.

    The normalized name and one boolean per pattern family are projected
    first, so the role CASE chain only tests boolean columns."""
    fams = {"f_ident": IDENTIFIER_PATTERNS, "f_contact": CONTACT_PATTERNS, "f_sens": SENSITIVE_PATTERNS,
            "f_temp": TEMPORAL_PATTERNS, "f_pct": PERCENTAGE_PATTERNS, "f_ord": ORDINAL_PATTERNS,
            "f_demo": DEMOGRAPHIC_PATTERNS, "f_money": MONETARY_PATTERNS, "f_add": ADDITIVE_PATTERNS,
            "f_ratio": RATIO_PATTERNS, "f_status": STATUS_PATTERNS, "f_geo": GEOGRAPHIC_PATTERNS}
    base = profile.withColumn("_name", normalized_name(F.col("column")))
    base = base.select("*", *[any_pattern(F.col("_name"), pats).alias(k) for k, pats in fams.items()])
    f = {k: F.col(k) for k in fams}
    t = F.col("type")
    phys = physical_type(t)
    numeric = (phys == "number") | t.isin("numeric", "currency", "percentage")
    ur = F.coalesce(F.col("unique_ratio"), F.lit(1.0))
    card = F.coalesce(F.col("cardinality_count"), F.lit(0))
    num_class = F.coalesce(F.col("cardinality_class"), F.when(card < 20, F.lit("low")).otherwise(F.lit("high")))
    txt_class = F.coalesce(F.col("cardinality_class"), F.when(card < 50, F.lit("medium")).otherwise(F.lit("high")))

    rules = [
        (f["f_ident"], IDENTIFIER, F.lit(0.97)),
        (f["f_contact"], CONTACT, F.lit(0.95)),
        (f["f_sens"], SENSITIVE, F.lit(0.95)),
        ((phys == "date") | f["f_temp"], TEMPORAL, F.when(phys == "date", F.lit(0.99)).otherwise(F.lit(0.88))),
        (phys == "boolean", STATUS, F.lit(0.92)),
        (numeric & ((t == "percentage") | f["f_pct"]), PERCENTAGE,
         F.when(t == "percentage", F.lit(0.99)).otherwise(F.lit(0.93))),
        (numeric & f["f_ord"], ORDINAL, F.lit(0.92)),
        (numeric & f["f_demo"], DEMOGRAPHIC, F.lit(0.95)),
        (numeric & ((t == "currency") | f["f_money"]), MONETARY,
         F.when(t == "currency", F.lit(0.99)).otherwise(F.lit(0.90))),
        (numeric & f["f_add"], ADDITIVE, F.lit(0.88)),
        (numeric & f["f_ratio"], RATIO, F.lit(0.85)),
        (numeric & (ur > 0.95) & (card > 20), IDENTIFIER, F.lit(0.80)),
        (numeric & num_class.isin("low", "binary"), ORDINAL, F.lit(0.65)),
        (numeric, ADDITIVE, F.lit(0.70)),
        ((phys == "string") & f["f_status"], STATUS, F.lit(0.92)),
        ((phys == "string") & f["f_geo"], GEOGRAPHIC, F.lit(0.90)),
        ((phys == "string") & (ur > 0.95) & (card > 50), TEXT, F.lit(0.78)),
        ((phys == "string") & (t.isin("categorical", "boolean") | txt_class.isin("binary", "low", "medium")),
         CATEGORICAL, F.lit(0.82)),
        (phys == "string", TEXT, F.lit(0.70)),
    ]
    role = conf = None
    for cond, r, c in rules:
        role = F.when(cond, F.lit(r)) if role is None else role.when(cond, F.lit(r))
        conf = F.when(cond, c) if conf is None else conf.when(cond, c)
    role = role.otherwise(F.lit(UNKNOWN))
    conf = conf.otherwise(F.lit(0.3))

    out = base.withColumn("physical_type", phys).withColumn("semantic_role", role) \
        .withColumn("confidence", conf).drop("_name", *fams)
    r = F.col("semantic_role")
    is_ident = r.isin(IDENTIFIER, CONTACT, SENSITIVE)
    is_sens = r.isin(SENSITIVE, CONTACT)
    is_temp = (r == TEMPORAL) | (t == "date")
    is_add = r.isin(MONETARY, ADDITIVE)
    is_agg = ~is_ident & ~is_temp & ~is_sens & ((F.col("physical_type") == "number") |
                                                 t.isin("numeric", "currency", "percentage")) & (r != UNKNOWN)
    cc = F.col("cardinality_class")
    is_dim = ~is_ident & ~is_sens & ~is_temp & (
        r.isin(CATEGORICAL, GEOGRAPHIC, STATUS) | t.isin("categorical", "boolean") |
        F.coalesce(cc.isNotNull() & (cc != "high"), F.lit(False)))
    return out.select(
        "*", is_add.alias("is_additive"), is_agg.alias("is_aggregatable"), is_dim.alias("is_dimensionalizable"),
        is_temp.alias("is_temporal"), is_ident.alias("is_identifier"), is_sens.alias("is_sensitive"),
        F.coalesce(F.col("null_ratio"), F.lit(0.0)).alias("null_ratio_f"),
        F.coalesce(F.col("cardinality_class"), F.lit("high")).alias("cardinality_class_f"))


def aggregation_rules(spark: SparkSession) -> DataFrame:
    """R4 as a small dimension table (one row per role; 16 rows, broadcast)."""
    rows = [(role, allowed, preferred, forbidden, default)
            for role, (allowed, preferred, forbidden, default) in AGGREGATION_RULES.items()]
    return spark.createDataFrame(
        rows, "semantic_role string, allowed array<string>, preferred array<string>, "
              "forbidden array<string>, default_aggregation string")


def normalize_aggregation(agg: Column) -> Column:
    low = F.lower(F.trim(agg))
    m = F.create_map(*[x for k, v in AGGREGATION_SYNONYMS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[low], low)


def _role_map(field: int) -> Column:
    """Constant map role -> one field of the rules (folded to a literal)."""
    kv = []
    for r, rule in AGGREGATION_RULES.items():
        v = rule[field]
        kv += [F.lit(r), F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)]
    return F.create_map(*kv)


def preferred_aggregation(role: Column) -> Column:
    """Default aggregation of a role (count for unknown roles)."""
    kv = []
    for r, (_, pref, _, default) in AGGREGATION_RULES.items():
        kv += [F.lit(r), F.lit(default or (pref[0] if pref else "count"))]
    return F.coalesce(F.create_map(*kv)[role], F.lit("count"))


def allowed_of(role: Column) -> Column:
    return _role_map(0)[role]


def preferred_of(role: Column) -> Column:
    return _role_map(1)[role]


def forbidden_of(role: Column) -> Column:
    return _role_map(2)[role]


def default_of(role: Column) -> Column:
    return _role_map(3)[role]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate table: write it once as Parquet
    into the shared folder named by spark.checkpoint.dir and read it back.
    (An unpersisted ``checkpoint()`` would compute the plan twice.)"""
    import uuid

    from ...session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def validate_aggregation(specs: DataFrame, rules: DataFrame, role_col: str = "semantic_role",
                         agg_col: str = "aggregation") -> DataFrame:
    """Valid / reason / suggested aggregation for (role, aggregation)
    pairs, via a broadcast join to the 16-row rules table."""
    a = normalize_aggregation(F.col(agg_col))
    j = specs.withColumn("_agg", a).join(F.broadcast(rules.withColumnRenamed("semantic_role", "_role")),
                                         F.col(role_col) == F.col("_role"), "left")
    forbidden = F.array_contains(F.col("forbidden"), F.col("_agg"))
    allowed = F.array_contains(F.col("allowed"), F.col("_agg")) | (F.col("_agg") == "none")
    valid = F.when(F.col("_role").isNull(), F.lit(False)).when(forbidden, F.lit(False)) \
        .when(allowed, F.lit(True)).otherwise(F.lit(False))
    reason = (F.when(F.col("_role").isNull(), F.format_string("no rules for the role %s", F.col(role_col)))
              .when(forbidden, F.format_string("%s makes no sense for columns of the role %s",
                                               F.col("_agg"), F.col(role_col)))
              .when(allowed, F.format_string("%s suits the role %s", F.col("_agg"),
                                             F.col(role_col)))
              .otherwise(F.format_string("%s is none of the aggregates for the role %s: %s",
                                         F.col("_agg"), F.col(role_col), F.array_join("allowed", ", "))))
    suggested = F.when(F.col("_role").isNull(), F.lit("count")).when(valid, F.lit(None)) \
        .otherwise(F.col("default_aggregation"))
    return j.select(*specs.columns, valid.alias("valid"), reason.alias("reason"), suggested.alias("suggested"))


# ------------------------------------------------------------------ R6

def column_groups(sem: DataFrame) -> DataFrame:
    """Assign every column to one group: ignored, identifier, temporal,
    measure, dimension."""
    g = (F.when(F.col("is_sensitive"), F.lit("ignored"))
         .when(F.col("is_identifier") & ~F.col("is_temporal"), F.lit("identifier"))
         .when(F.col("is_temporal"), F.lit("temporal"))
         .when(F.col("is_aggregatable"), F.lit("measure"))
         .when(F.col("is_dimensionalizable"), F.lit("dimension"))
         .otherwise(F.lit("ignored")))
    return sem.withColumn("group", g)


def relationships(sem: DataFrame) -> DataFrame:
    """Typed column relationships with analytical value, per dataset.

    Output (dataset_id, type, x_column, y_column, x_role, y_role, value,
    x_ordinal, y_ordinal, seq) where ``seq`` orders relationships the way
    they are generated (type block, then column order)."""
    g = column_groups(sem).select("dataset_id", "ordinal", "column", "semantic_role", "group",
                                  "is_additive", "null_ratio_f", "cardinality_class_f")
    cols = ["dataset_id", "type", "x_column", "y_column", "x_role", "y_role", "value", "x_ordinal", "y_ordinal",
            "block"]

    def side(df, p):
        return df.select(F.col("dataset_id"), *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != "dataset_id"])

    t = side(g.filter(F.col("group") == "temporal"), "t_")
    m = side(g.filter(F.col("group") == "measure"), "m_")
    d = side(g.filter(F.col("group") == "dimension"), "d_")
    m2 = side(g.filter(F.col("group") == "measure"), "n_")
    ident = g.filter(F.col("group") == "identifier")

    tm_val = F.least(F.lit(100), F.lit(85) + F.when(F.col("m_semantic_role") == MONETARY, 10).otherwise(0)
                     + F.when(F.col("m_semantic_role") == ADDITIVE, 5).otherwise(0)
                     - F.when(F.col("m_null_ratio_f") > 0.3, 10).otherwise(0))
    tm = t.join(m, "dataset_id").select(
        "dataset_id", F.lit("temporal-measure").alias("type"), F.col("t_column").alias("x_column"),
        F.col("m_column").alias("y_column"), F.col("t_semantic_role").alias("x_role"),
        F.col("m_semantic_role").alias("y_role"), tm_val.alias("value"), F.col("t_ordinal").alias("x_ordinal"),
        F.col("m_ordinal").alias("y_ordinal"), F.lit(0).alias("block"))
    tc = t.select("dataset_id", F.lit("temporal-count").alias("type"), F.col("t_column").alias("x_column"),
                  F.lit("_count").alias("y_column"), F.col("t_semantic_role").alias("x_role"),
                  F.lit(None).cast("string").alias("y_role"), F.lit(70).alias("value"),
                  F.col("t_ordinal").alias("x_ordinal"), F.lit(10_000).alias("y_ordinal"), F.lit(0).alias("block"))
    dcc = F.col("d_cardinality_class_f")
    dm_val = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(75) + F.when(F.col("m_is_additive"), 10).otherwise(0)
                        + F.when(dcc == "low", 8).when(dcc == "medium", 4).when(dcc == "high", -20).otherwise(0)
                        - F.when(F.col("m_null_ratio_f") > 0.3, 8).otherwise(0)))
    dm = d.join(m, "dataset_id").select(
        "dataset_id", F.lit("dimension-measure").alias("type"), F.col("d_column").alias("x_column"),
        F.col("m_column").alias("y_column"), F.col("d_semantic_role").alias("x_role"),
        F.col("m_semantic_role").alias("y_role"), dm_val.alias("value"), F.col("d_ordinal").alias("x_ordinal"),
        F.col("m_ordinal").alias("y_ordinal"), F.lit(1).alias("block"))
    dc_val = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(68) + F.when(dcc == "binary", 12).when(dcc == "low", 8)
                        .when(dcc == "medium", 4).otherwise(-18)))
    dc = d.select("dataset_id", F.lit("dimension-count").alias("type"), F.col("d_column").alias("x_column"),
                  F.lit("_count").alias("y_column"), F.col("d_semantic_role").alias("x_role"),
                  F.lit(None).cast("string").alias("y_role"), dc_val.alias("value"),
                  F.col("d_ordinal").alias("x_ordinal"), F.lit(10_000).alias("y_ordinal"), F.lit(1).alias("block"))
    mm = m.join(m2, "dataset_id").filter(F.col("m_ordinal") < F.col("n_ordinal")).select(
        "dataset_id", F.lit("measure-measure").alias("type"), F.col("m_column").alias("x_column"),
        F.col("n_column").alias("y_column"), F.col("m_semantic_role").alias("x_role"),
        F.col("n_semantic_role").alias("y_role"), F.lit(65).alias("value"), F.col("m_ordinal").alias("x_ordinal"),
        F.col("n_ordinal").alias("y_ordinal"), F.lit(2).alias("block"))
    md = m.select("dataset_id", F.lit("measure-distribution").alias("type"), F.col("m_column").alias("x_column"),
                  F.lit(None).cast("string").alias("y_column"), F.col("m_semantic_role").alias("x_role"),
                  F.lit(None).cast("string").alias("y_role"), F.lit(60).alias("value"),
                  F.col("m_ordinal").alias("x_ordinal"), F.lit(-1).alias("y_ordinal"), F.lit(3).alias("block"))
    ic = ident.select("dataset_id", F.lit("identifier-count").alias("type"), F.col("column").alias("x_column"),
                      F.lit(None).cast("string").alias("y_column"), F.col("semantic_role").alias("x_role"),
                      F.lit(None).cast("string").alias("y_role"), F.lit(80).alias("value"),
                      F.col("ordinal").alias("x_ordinal"), F.lit(-1).alias("y_ordinal"), F.lit(4).alias("block"))
    out = tm
    for p in (tc, dm, dc, mm, md, ic):
        out = out.unionByName(p)
    out = out.select(*cols)
    w = Window.partitionBy("dataset_id").orderBy("block", "x_ordinal", "y_ordinal")
    return out.withColumn("seq", F.row_number().over(w)).drop("block")


# ------------------------------------------------------------------ R7

def capabilities(rel: DataFrame, sem: DataFrame) -> DataFrame:
    """(dataset_id, capability, score, count) per dataset."""
    dims = column_groups(sem).filter(F.col("group") == "dimension") \
        .select("dataset_id", F.col("column").alias("x_column"), F.col("cardinality_class_f").alias("dim_class"))
    r = rel.join(dims, ["dataset_id", "x_column"], "left")
    n_measures = column_groups(sem).groupBy("dataset_id").agg(
        F.count_if(F.col("group") == "measure").alias("n_measures"))
    typ = F.col("type")
    agg = r.groupBy("dataset_id").agg(
        F.max(F.when(typ == "temporal-measure", F.col("value"))).alias("ts_score"),
        F.count_if(typ == "temporal-measure").alias("ts_count"),
        F.max(F.when((typ == "dimension-measure") & (F.col("dim_class") != "high"), F.col("value"))).alias("bd_score"),
        F.count_if((typ == "dimension-measure") & (F.col("dim_class") != "high")).alias("bd_count"),
        F.max(F.when(typ == "dimension-count", F.col("value"))).alias("fq_score"),
        F.count_if(typ == "dimension-count").alias("fq_count"),
        F.count_if(typ == "measure-measure").alias("cr_count"),
        F.count_if(typ == "identifier-count").alias("ec_count"),
        F.count_if((typ == "dimension-count") & F.col("dim_class").isin("binary", "low")).alias("pr_count"),
    ).join(n_measures, "dataset_id", "right").fillna(0, ["ts_count", "bd_count", "fq_count", "cr_count",
                                                         "ec_count", "pr_count"])
    def cap(name, score, count, ok):
        return F.struct(F.lit(name).alias("capability"), score.cast("int").alias("score"),
                        count.cast("long").alias("count"), ok.alias("ok"))
    caps = F.array(
        cap("time_series", F.col("ts_score"), F.col("ts_count"), F.col("ts_count") > 0),
        cap("trend_analysis", F.lit(78), F.least(F.col("ts_count"), F.lit(2)), F.col("ts_count") > 0),
        cap("breakdown", F.col("bd_score"), F.col("bd_count"), F.col("bd_count") > 0),
        cap("frequency", F.col("fq_score"), F.col("fq_count"), F.col("fq_count") > 0),
        cap("distribution", F.lit(62), F.col("n_measures"), F.col("n_measures") > 0),
        cap("correlation", F.lit(68), F.col("cr_count"), F.col("cr_count") > 0),
        cap("entity_count", F.lit(82), F.col("ec_count"), F.col("ec_count") > 0),
        cap("proportion", F.lit(75), F.col("pr_count"), F.col("pr_count") > 0),
    )
    out = agg.select("dataset_id", F.inline(caps)).filter("ok").drop("ok")
    return out.withColumn("score", F.col("score").cast("int"))


# ------------------------------------------------------------------ R8

def intents(rel: DataFrame, sem: DataFrame) -> DataFrame:
    """KPI and chart intents with the per-capability caps.

    Output (dataset_id, kind kpi|chart, type, x_column, y_column,
    aggregation, chart_type, priority, value, semantic_role, seq)."""
    s = column_groups(sem)
    pref = preferred_aggregation(F.col("semantic_role"))
    role_val = F.coalesce(F.create_map(*[x for k, v in KPI_ROLE_VALUE.items() for x in (F.lit(k), F.lit(v))])
                          [F.col("semantic_role")], F.lit(50))
    kpi = s.filter(F.col("is_aggregatable") & ~F.col("is_identifier") & ~F.col("is_sensitive") &
                   ~F.col("is_temporal")) \
        .withColumn("agg", pref).filter(~F.col("agg").isin("group_by", "date_grouping", "trend")) \
        .select("dataset_id", F.lit("kpi").alias("kind"), F.lit("kpi_aggregate").alias("type"),
                F.col("column").alias("x_column"), F.lit(None).cast("string").alias("y_column"),
                F.col("agg").alias("aggregation"), F.lit(None).cast("string").alias("chart_type"),
                F.when(F.col("semantic_role").isin(MONETARY, ADDITIVE), F.lit("primary"))
                .otherwise(F.lit("secondary")).alias("priority"),
                role_val.alias("value"), "semantic_role", F.col("ordinal").alias("seq"))
    ent = rel.filter(F.col("type") == "identifier-count").select(
        "dataset_id", F.lit("kpi").alias("kind"), F.lit("kpi_entity_count").alias("type"), "x_column",
        F.lit(None).cast("string").alias("y_column"), F.lit("count_distinct").alias("aggregation"),
        F.lit(None).cast("string").alias("chart_type"), F.lit("primary").alias("priority"), "value",
        F.lit(IDENTIFIER).alias("semantic_role"), (F.col("seq") + 100_000).alias("seq"))

    roles = s.select("dataset_id", F.col("column").alias("y_column"), F.col("semantic_role").alias("y_sem"))
    dims = s.filter(F.col("group") == "dimension").select(
        "dataset_id", F.col("column").alias("x_column"), F.col("cardinality_class_f").alias("dim_class"))
    r = rel.join(roles, ["dataset_id", "y_column"], "left").join(dims, ["dataset_id", "x_column"], "left")
    ypref = F.when(F.col("y_sem").isNull(), F.lit("sum")).otherwise(preferred_aggregation(F.col("y_sem")))
    rank_w = Window.partitionBy("dataset_id").orderBy(F.desc("value"), "seq")

    def chart(cond, typ, cap, agg, chart_type, primary_at, ycol=None, by_value=True):
        c = r.filter(cond)
        w = rank_w if by_value else Window.partitionBy("dataset_id").orderBy("seq")
        c = c.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= cap)
        pri = F.lit("secondary") if primary_at is None else \
            F.when(F.col("value") >= primary_at, F.lit("primary")).otherwise(F.lit("secondary"))
        return c.select("dataset_id", F.lit("chart").alias("kind"), F.lit(typ).alias("type"), "x_column",
                        (F.col("y_column") if ycol is None else F.lit(ycol)).alias("y_column"),
                        agg.alias("aggregation"), F.lit(chart_type).alias("chart_type"), pri.alias("priority"),
                        "value", F.col("y_role").alias("semantic_role"), (F.col("seq") + 200_000).alias("seq"))

    typ = F.col("type")
    parts = [
        kpi, ent,
        chart(typ == "temporal-measure", "time_series", INTENT_CAPS["time_series"],
              F.when(ypref.isin("group_by", "trend", "date_grouping"), F.lit("sum")).otherwise(ypref), "line", 90),
        chart((typ == "dimension-measure") & (F.col("dim_class") != "high"), "categorical_breakdown",
              INTENT_CAPS["breakdown"],
              F.when(ypref.isin("group_by", "trend", "date_grouping"), F.lit("count")).otherwise(ypref), "bar", 78),
        chart(typ == "dimension-count", "frequency_distribution", INTENT_CAPS["frequency"], F.lit("count"), "bar",
              None, "_count"),
        chart((typ == "dimension-count") & F.col("dim_class").isin("binary", "low"), "proportion",
              INTENT_CAPS["proportion"], F.lit("count"), "pie", None, "_count"),
        chart(typ == "measure-measure", "correlation", INTENT_CAPS["correlation"], F.lit("none"), "scatter", None,
              by_value=False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ R3

# Rule-engine patterns.
ID_SUFFIX_RE = r"(_id|Id)$"
ID_EXACT_RE = r"(?i)^(id|uuid|guid)$"
ID_SPECIFIC_RE = r"(?i)^(customer_id|order_id|invoice_id|employee_id)$"
ADDRESS_NAME_RE = r"(?i)address|street|city|zipcode|postal"


def business_roles(profile: DataFrame) -> DataFrame:
    """Identifier / ignore (e-mail, phone, URL > 80 % of values, address
    names) / metric / dimension, with confidence and a review flag below
    0.6.  Uses the metadata type (P5) and value counts of the profile."""
    name, mt = F.col("column"), F.col("metadata_type")
    ne = F.greatest(F.col("non_empty"), F.lit(1))
    uniq, rows = F.col("distinct_raw"), F.col("rows")
    ident = name.rlike(ID_EXACT_RE) | name.rlike(ID_SUFFIX_RE) | name.rlike(ID_SPECIFIC_RE)
    text = mt == "text"
    has_vals = F.col("non_empty") > 0
    email = text & has_vals & (F.col("n_email") / ne > 0.8)
    phone = text & has_vals & (F.col("n_phone") / ne > 0.8)
    url = text & has_vals & (F.col("n_url") / ne > 0.8)
    address = text & has_vals & name.rlike(ADDRESS_NAME_RE) & (F.col("len_sum") / ne >= 2)
    ambiguous = (mt == "numeric") & (uniq > 0) & (uniq < 20)
    low_card = (uniq < 20) | ((rows > 0) & (uniq / F.greatest(rows, F.lit(1)) < 0.05))
    rules = [
        (ident, "identifier", "identifier", F.lit(0.95), F.lit(False)),
        (email, "text", "ignore", F.lit(0.9), F.lit(False)),
        (phone, "text", "ignore", F.lit(0.9), F.lit(False)),
        (url, "text", "ignore", F.lit(0.9), F.lit(False)),
        (address, "text", "ignore", F.lit(0.85), F.lit(False)),
        (mt.isin("numeric", "currency", "percentage"), None, "metric",
         F.when(ambiguous, F.lit(0.55)).otherwise(F.lit(0.9)), ambiguous),
        (mt.isin("date", "boolean"), None, "dimension", F.lit(0.95), F.lit(False)),
        (text & low_card, "category", "dimension", F.lit(0.85), F.lit(False)),
        (text, "text", "ignore", F.lit(0.45), F.lit(True)),
    ]
    det = rol = conf = rev = None
    for cond, d, r, c, v in rules:
        dcol = mt if d is None else F.lit(d)
        det = F.when(cond, dcol) if det is None else det.when(cond, dcol)
        rol = F.when(cond, F.lit(r)) if rol is None else rol.when(cond, F.lit(r))
        conf = F.when(cond, c) if conf is None else conf.when(cond, c)
        rev = F.when(cond, v) if rev is None else rev.when(cond, v)
    det, rol = det.otherwise(F.lit("text")), rol.otherwise(F.lit("ignore"))
    conf, rev = conf.otherwise(F.lit(0.3)), rev.otherwise(F.lit(True))
    return profile.select("dataset_id", "ordinal", "column", det.alias("detected_type"), rol.alias("business_role"),
                          conf.alias("confidence"), (rev | (conf < 0.6)).alias("needs_review"))
