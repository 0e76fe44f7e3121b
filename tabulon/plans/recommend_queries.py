"""Registered catalog recommendation queries.

They run over the column profiles of all warehouse tables (derived by Spark
from the tables themselves).  The profile job is the expensive part and is
materialized once per warehouse folder; the rule steps are small joins and
windows per dataset.  Most outputs are rule results without an SQL oracle
(rows-only check) and are covered by literal-row tests instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import TABLES, table
from . import recommend_oracles as RO
from .catalog_queries import register
from .recommend import candidates as C
from .recommend import catalog as CT
from .recommend import domain as D
from .recommend import semantics as S

CATALOG_TABLES = TABLES

_TABLE_LIST = ", ".join(f"'{t}'" for t in CATALOG_TABLES)
# the profiled columns of every table, as DuckDB's catalog lists them
_COLS_SQL = f"""cols AS (
  SELECT table_name AS dataset_id, ordinal_position AS ordinal, column_name AS "column"
  FROM information_schema.columns
  WHERE table_name IN ({_TABLE_LIST}) AND data_type NOT LIKE '%[]' AND data_type NOT LIKE 'STRUCT%'
    AND data_type NOT LIKE 'MAP%' AND data_type NOT LIKE 'BLOB%')"""


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _domain_sql() -> str:
    kw = ", ".join(f"({d}, {_q(dom)}, {_q(lbl)}, {_q(kind)}, {k}, {_q(w)})"
                   for d, (dom, lbl, prim, sec) in enumerate(D.DOMAIN_KEYWORDS)
                   for kind, words in (("primary", prim), ("secondary", sec)) for k, w in enumerate(words))
    return f"""
WITH {_COLS_SQL},
kw(domain_order, domain, domain_label, kind, kw_order, kw) AS (VALUES {kw}),
names AS (SELECT dataset_id, regexp_replace(lower("column"), '[^a-z0-9_]', '_', 'g') AS n FROM cols),
col_hits AS (
  SELECT DISTINCT names.dataset_id, domain_order, domain, domain_label, kind, kw_order,
         CASE WHEN kind = 'primary' THEN 3 ELSE 1 END AS pts
  FROM names JOIN kw ON (n = kw OR contains(n, kw) OR (kind = 'primary' AND contains(kw, n)))),
files AS (SELECT DISTINCT dataset_id, regexp_replace(lower(dataset_id || '.parquet'), '[^a-z0-9]', '_', 'g') AS fn
          FROM cols),
file_hits AS (SELECT dataset_id, domain_order, domain, domain_label, kind, kw_order, 2 AS pts
              FROM files JOIN kw ON kind = 'primary' AND contains(fn, kw)),
scores AS (SELECT dataset_id, domain_order, domain, domain_label, SUM(pts) AS score
           FROM (SELECT * FROM col_hits UNION ALL SELECT * FROM file_hits)
           GROUP BY dataset_id, domain_order, domain, domain_label),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY score DESC, domain_order) AS rk,
                  SUM(score) OVER (PARTITION BY dataset_id) AS total FROM scores),
top AS (SELECT t.*, COALESCE(s.score, 0) AS second FROM ranked t
        LEFT JOIN ranked s ON s.dataset_id = t.dataset_id AND s.rk = 2 WHERE t.rk = 1),
found AS (SELECT dataset_id, domain, domain_label, score,
  FLOOR(LEAST(0.97, GREATEST(0.45, 0.5 + score / total * 0.4 + LEAST(score / (second + 1) / 10, 0.07))) * 100 + 0.5)
    / 100 AS confidence FROM top)
SELECT d.dataset_id, COALESCE(domain, 'general') AS domain, COALESCE(domain_label, 'General / Analytics') AS domain_label,
       COALESCE(confidence, 0.4) AS confidence, COALESCE(score, 0) AS score
FROM (SELECT DISTINCT dataset_id FROM cols) d LEFT JOIN found USING (dataset_id)
"""


def _mapping_sql() -> str:
    syn = ", ".join(f"({_q(k)}, {i}, {_q(w)})" for k, ws in CT.KPI_SYNONYMS.items() for i, w in enumerate(ws))
    cur = ", ".join(_q(k) for k in CT.CURRENCY_KPIS)
    return f"""
WITH {_COLS_SQL},
syn(kpi, syn_order, synonym) AS (VALUES {syn}),
hits AS (SELECT c.dataset_id, s.kpi, s.syn_order, c.ordinal, c."column" FROM cols c
         JOIN syn s ON contains(lower(c."column"), s.synonym)),
auto AS (SELECT dataset_id, kpi, "column" AS auto_column FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, kpi ORDER BY syn_order, ordinal) AS rn FROM hits)
         WHERE rn = 1),
ov AS (SELECT dataset_id, 'revenue' AS kpi, "column" AS override_column FROM cols
       WHERE "column" IN ('o_totalprice', 'l_extendedprice')
       UNION ALL SELECT dataset_id, 'profit', 'no_such_column' FROM cols WHERE "column" = 'c_acctbal'),
ovk AS (SELECT ov.*, EXISTS (SELECT 1 FROM cols c WHERE c.dataset_id = ov.dataset_id
                             AND c."column" = ov.override_column) AS known FROM ov),
keys AS (SELECT dataset_id, kpi FROM auto UNION SELECT dataset_id, kpi FROM ov)
SELECT k.dataset_id, k.kpi,
       CASE WHEN COALESCE(o.known, false) THEN o.override_column ELSE a.auto_column END AS "column",
       CASE WHEN COALESCE(o.known, false) THEN 'override' ELSE 'synonym' END AS source,
       upper(substr(k.kpi, 1, 1)) || replace(substr(k.kpi, 2), '_', ' ') AS label,
       CASE WHEN lower(k.kpi) IN ({cur}) THEN 'currency' ELSE 'number' END AS format,
       CASE WHEN o.override_column IS NOT NULL AND NOT COALESCE(o.known, false)
            THEN printf('the dataset has no column %s for the KPI %s', o.override_column, k.kpi) END AS error
FROM keys k LEFT JOIN auto a USING (dataset_id, kpi) LEFT JOIN ovk o USING (dataset_id, kpi)
"""


_REWRITE_SQL = f"""
WITH {_COLS_SQL},
specs AS (SELECT dataset_id, "column" AS x_field, 'quantity' AS y_field, 'avg' AS aggregation FROM cols
          UNION ALL SELECT dataset_id, 'order_id', 'quantity', 'avg' FROM cols WHERE ends_with("column", 'orderkey')),
cust AS (SELECT dataset_id, arg_min("column", ordinal) AS cust FROM cols
         WHERE regexp_matches(lower("column"), 'customer_id|customer|cust') GROUP BY dataset_id),
j AS (SELECT s.*, c.cust, lower(x_field) = 'order_id' AND lower(y_field) = 'quantity' AND lower(aggregation) = 'avg'
             AND c.cust IS NOT NULL AS hit FROM specs s LEFT JOIN cust c USING (dataset_id))
SELECT dataset_id, CASE WHEN hit THEN cust ELSE x_field END AS x_field, y_field, aggregation,
       CASE WHEN hit THEN 'Average quantity per customer' END AS custom_title FROM j
"""


_RUNS: dict[str, CT.Recommendation] = {}


def _state(spark, base: str) -> tuple:
    """What the input files are at this moment: count, bytes, and a checksum of
    paths, lengths and times.  Only the listing is read."""
    f = None
    for t in CATALOG_TABLES:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base.rstrip('/')}/{t}.parquet").select("path", "length", "modificationTime")
        f = one if f is None else f.unionByName(one)
    return tuple(f.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def _run(spark, base) -> CT.Recommendation:
    """The run that these queries share; a new one whenever the session, the
    folder or a file in it is another."""
    key = (spark.sparkContext.applicationId, base, _state(spark, base))
    if _RUNS.get("key") != key:
        _RUNS.clear()
        _RUNS.update(key=key, run=CT.Recommendation(CT.column_profile(spark, base, CATALOG_TABLES)))
    return _RUNS["run"]


def _profile(spark, base):
    return _run(spark, base).profile


def _sem(spark, base):
    return _run(spark, base).sem


@register("r01_roles", RO.ROLES_SQL)
def r01_roles(spark, base):
    return _sem(spark, base).select("dataset_id", "ordinal", "column", "type", "physical_type", "semantic_role",
                                    "confidence", "is_additive", "is_aggregatable", "is_dimensionalizable",
                                    "is_temporal", "is_identifier", "is_sensitive")


@register("r03_business_roles")
def r03_business_roles(spark, base):
    return S.business_roles(_profile(spark, base))


@register("r04_aggregation_rules", RO.RULES_SQL)
def r04_aggregation_rules(spark, base):
    sem = _sem(spark, base).select("dataset_id", "column", "semantic_role")
    aggs = F.array(*[F.lit(a) for a in ("sum", "Average", "count distinct", "median", "none", "trend")])
    specs = sem.select("*", F.explode(aggs).alias("aggregation"))
    return S.validate_aggregation(specs, S.aggregation_rules(spark))


@register("r05_domains", _domain_sql())
def r05_domains(spark, base):
    p = _profile(spark, base)
    return D.classify_domains(p.select("dataset_id", "column"), CT.datasets_of(p))


@register("r06_relationships", RO.RELATIONSHIPS_SQL)
def r06_relationships(spark, base):
    return _run(spark, base).relationships


@register("r07_capabilities", RO.CAPABILITIES_SQL)
def r07_capabilities(spark, base):
    run = _run(spark, base)
    return S.capabilities(run.relationships, run.sem)


@register("r08_intents", RO.INTENTS_SQL)
def r08_intents(spark, base):
    return _run(spark, base).intents


@register("r09_kpi_candidates", RO.kpi_candidates_sql(C.ROLE_FORMAT, C.ROLE_BUSINESS_VALUE))
def r09_kpi_candidates(spark, base):
    return C.score_kpis(_run(spark, base).kpi_candidates)


@register("r10_chart_candidates", RO.chart_candidates_sql(C.ROLE_BUSINESS_VALUE, C.CHART_TYPE_FIT, C.MAX_PIE_CATEGORIES, C.MAX_CATEGORICAL_CARDINALITY))
def r10_chart_candidates(spark, base):
    return C.score_charts(_run(spark, base).chart_candidates)


@register("r11_domain_kpis")
def r11_domain_kpis(spark, base):
    run = _run(spark, base)
    return D.domain_kpi_candidates(run.sem, run.domains)


@register("r12_domain_charts")
def r12_domain_charts(spark, base):
    run = _run(spark, base)
    return D.domain_chart_candidates(run.sem, run.domains)


@register("r13_external_specs", RO.EXTERNAL_SQL)
def r13_external_specs(spark, base):
    sem = _sem(spark, base)
    aggs = F.array(*[F.lit(a) for a in ("sum", "avg", "count_distinct")])
    specs = sem.select("dataset_id", "column", F.explode(aggs).alias("aggregation"))
    specs = specs.unionByName(sem.select("dataset_id", F.concat(F.col("column"), F.lit("_missing")).alias("column"),
                                         F.lit("sum").alias("aggregation")))
    return CT.validate_external_kpis(specs, sem)


@register("r17_final_kpis")
def r17_final_kpis(spark, base):
    kpis = _run(spark, base).kpis
    return kpis.select("dataset_id", "rank", "kpi", "column", "aggregation", "title", "format", "semantic_role",
                       "priority", "score", "source")


@register("r17_final_charts")
def r17_final_charts(spark, base):
    charts = _run(spark, base).charts
    return charts.select("dataset_id", "rank", "chart_type", "x_field", "y_field", "aggregation", "title",
                         "priority", "score", "intent_type", "source")


@register("r18_best_chart")
def r18_best_chart(spark, base):
    return CT.best_chart(_profile(spark, base))


@register("r19_overrides", _mapping_sql())
def r19_overrides(spark, base):
    p = _profile(spark, base)
    ov = p.filter(F.col("column").isin("o_totalprice", "l_extendedprice")).select(
        "dataset_id", F.lit("revenue").alias("kpi"), "column")
    bad = p.filter(F.col("column") == "c_acctbal").select("dataset_id", F.lit("profit").alias("kpi"),
                                                           F.lit("no_such_column").alias("column"))
    return CT.kpi_mapping(p, ov.unionByName(bad))


_ROUTING = RO.routing_sql("SELECT 'orders' AS dataset_id, conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user'",
                          RO.KINDS, (CT.COMPARE_WORDS_RE, CT.TOP_WORDS_RE, CT.ASC_WORDS_RE), CT.AGG_WORDS)


@register("r20_routing", f"WITH {_ROUTING} SELECT * FROM routed")
def r20_routing(spark, base):
    conv = table(spark, base, "conversations").filter(F.col("role") == "user")
    qs = conv.select(F.lit("orders").alias("dataset_id"),
                     F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
                     F.col("text").alias("question"))
    return CT.route_questions(qs, _profile(spark, base))


@register("r21_rewrite", _REWRITE_SQL)
def r21_rewrite(spark, base):
    p = _profile(spark, base)
    specs = p.select("dataset_id", F.col("column").alias("x_field"), F.lit("quantity").alias("y_field"),
                     F.lit("avg").alias("aggregation"))
    renamed = p.filter(F.col("column").endswith("orderkey")).select(
        "dataset_id", F.lit("order_id").alias("x_field"), F.lit("quantity").alias("y_field"),
        F.lit("avg").alias("aggregation"))
    return CT.rewrite_specs(specs.unionByName(renamed), p)


@register("r22_series_kind", RO.SERIES_KIND_SQL)
def r22_series_kind(spark, base):
    sem = _sem(spark, base)
    specs = sem.select("dataset_id", F.col("column").alias("x_field"),
                       F.when(F.col("is_aggregatable"), F.lit("none")).otherwise(F.lit("sum")).alias("aggregation"))
    return CT.series_kind(specs, sem)


@register("r23_questions", RO.questions_sql(CT.SUGGESTED_QUESTIONS))
def r23_questions(spark, base):
    return CT.suggested_questions(_profile(spark, base))


@register("g07_insights")
def g07_insights(spark, base):
    from ..operators import periods as PD
    from ..operators import rules as RU
    from . import insights as IN
    o = table(spark, base, "orders")
    cards = PD.kpi_cards(o, [PD.KpiSpec("revenue", "o_totalprice", "sum", "Revenue"),
                             PD.KpiSpec("orders", "o_orderkey", "count", "Orders")], "o_orderdate", "30days")
    cards = S.materialize(cards)
    alerts = RU.rule_alerts(table(spark, base, "customer"), [
        RU.Rule("negative-profit", "Negative balance", "c_acctbal", 0, "<")])
    fmt = cards.withColumn("format", F.when(F.col("kpi") == "revenue", F.lit("currency")).otherwise(F.lit("number")))
    ins = IN.kpi_insights(fmt, PD.growth_card(cards), alerts)
    recs = IN.recommendations(F.lit(1), alerts).select(F.lit("recommendation").alias("id"),
                                                       F.col("type").alias("category"),
                                                       F.col("type").alias("severity"), F.col("message").alias("text"))
    return ins.unionByName(recs)


def _plain_sql(x: str, d: int) -> str:
    """A number with up to d decimals, thousands grouped, no trailing zeros (x >= 0)."""
    rounded = f"FLOOR({x} * {10 ** d} + 0.5) / {10 ** d}"
    return f"regexp_replace(regexp_replace(format('{{:,.{d}f}}', {rounded}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _short_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e9 THEN {_plain_sql(f'({x} / 1e9)', 1)} || 'B' WHEN {x} >= 1e6 THEN {_plain_sql(f'({x} / 1e6)', 1)} || 'M' "
            f"WHEN {x} >= 1e3 THEN {_plain_sql(f'({x} / 1e3)', 1)} || 'K' ELSE {_plain_sql(x, 1)} END")


@register("g08_format", f"""
SELECT l_returnflag, '₹' || {_short_sql('v')} AS total, {_short_sql('d')} AS avg_discount, {_plain_sql('d', 2)} || '%' AS pct
FROM (SELECT l_returnflag, SUM(l_extendedprice) AS v, AVG(l_discount) AS d FROM lineitem GROUP BY 1)
""")
def g08_format(spark, base):
    from . import insights as IN
    li = table(spark, base, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("d"))
    return g.select("l_returnflag", IN.format_value("v", "currency").alias("total"),
                    IN.format_value("d").alias("avg_discount"), IN.format_kpi("d", "percent").alias("pct"))
