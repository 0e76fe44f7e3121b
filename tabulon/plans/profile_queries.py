"""Registered profiling and data-quality queries (P1-P20) with oracles.

The oracle SQL is generated per table from the same fixed patterns the
Spark predicates use, so both sides apply identical rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PF
from ..sources.tables import table
from .catalog_queries import register

PROFILE_TABLES = ("customer", "part")
PROFILE_OUT = ["table_name", "ordinal", "column", "rows", "missing", "non_empty", "distinct_ci",
               "null_ratio", "unique_ratio", "cardinality_class", "n_email", "n_phone", "n_currency",
               "n_percentage", "n_numeric", "n_date", "n_boolean", "type", "detected_type",
               "num_min", "num_max", "high_cardinality"]

# DuckDB spellings of the Spark date formats (same order).
_DUCK_FORMATS = ["%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%Y.%m.%d", "%Y/%m/%d",
                 "%d %b %Y", "%b %d, %Y", "%b %d %Y", "%b %Y"]


def _duck_finite(x: str) -> str:
    return f"(TRY_CAST({x} AS DOUBLE) IS NOT NULL AND isfinite(TRY_CAST({x} AS DOUBLE)))"


def _duck_profile_sql(tbl: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS raw FROM {tbl}"
        for i, c in enumerate(cols))
    cur = "[$€£¥₽₨₹,\\s]"
    fmts = "[" + ", ".join(f"'{f}'" for f in _DUCK_FORMATS) + "]"
    parse = f"COALESCE(TRY_CAST(v AS TIMESTAMP), try_strptime(v, {fmts}))"
    num_clean = "trim(regexp_replace(v, '[$,]', '', 'g'))"
    cur_clean = f"regexp_replace(v, '{cur}', '', 'g')"
    pct_body = "trim(regexp_replace(v, '%$', ''))"
    months = "|".join(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])
    date_pred = (f"(NOT regexp_matches(v, '^\\d{{1,4}}$') AND (regexp_matches(v, '\\d{{1,4}}[/\\-.]\\d{{1,2}}') "
                 f"OR regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches(lower(v), '{months}')) "
                 f"AND {parse} IS NOT NULL AND year({parse}) BETWEEN 2000 AND 2100)")
    email = "regexp_matches(v, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"
    phone = "regexp_matches(v, '^\\+?[\\d\\s\\-()]{7,20}$')"
    boolean = "lower(v) IN ('true','false','yes','no','1','0','y','n')"
    return f"""
SELECT '{tbl}' AS table_name, ordinal, "column", rows, missing, non_empty, distinct_ci,
  FLOOR(CAST(rows - non_empty AS DOUBLE) / GREATEST(rows, 1) * 10000.0 + 0.5) / 10000.0 AS null_ratio,
  FLOOR(CAST(distinct_ci AS DOUBLE) / GREATEST(non_empty, 1) * 10000.0 + 0.5) / 10000.0 AS unique_ratio,
  CASE WHEN distinct_ci <= 2 THEN 'binary' WHEN distinct_ci <= 10 THEN 'low' WHEN distinct_ci < 50 THEN 'medium'
       ELSE 'high' END AS cardinality_class,
  n_email, n_phone, n_currency, n_percentage, n_numeric, n_date, n_boolean,
  CASE WHEN non_empty = 0 THEN 'text'
       WHEN n_email / non_empty >= 0.8 THEN 'text' WHEN n_date / non_empty >= 0.8 THEN 'date'
       WHEN n_phone / non_empty >= 0.8 THEN 'text' WHEN n_currency / non_empty >= 0.8 THEN 'numeric'
       WHEN n_percentage / non_empty >= 0.8 THEN 'numeric' WHEN n_numeric / non_empty >= 0.8 THEN 'numeric'
       WHEN n_boolean / non_empty >= 0.8 THEN 'boolean'
       WHEN distinct_ci <= 20 OR CAST(distinct_ci AS DOUBLE) / GREATEST(rows, 1) <= 0.15 THEN 'categorical'
       ELSE 'text' END AS type,
  CASE WHEN non_empty = 0 THEN 'Text'
       WHEN n_email / non_empty >= 0.8 THEN 'Email' WHEN n_date / non_empty >= 0.8 THEN 'Date'
       WHEN n_phone / non_empty >= 0.8 THEN 'Phone Number' WHEN n_currency / non_empty >= 0.8 THEN 'Currency'
       WHEN n_percentage / non_empty >= 0.8 THEN 'Percentage' WHEN n_numeric / non_empty >= 0.8 THEN 'Number'
       WHEN n_boolean / non_empty >= 0.8 THEN 'Boolean'
       WHEN distinct_ci <= 20 OR CAST(distinct_ci AS DOUBLE) / GREATEST(rows, 1) <= 0.15 THEN 'Category'
       ELSE 'Text' END AS detected_type,
  num_min, num_max,
  rows > 5 AND CAST(distinct_ci AS DOUBLE) / GREATEST(rows, 1) >= 0.9 AS high_cardinality
FROM (
  SELECT ordinal, "column", COUNT(*) AS rows,
    COUNT(CASE WHEN raw IS NULL OR trim(raw) = '' THEN 1 END) AS missing,
    COUNT(CASE WHEN p THEN 1 END) AS non_empty,
    COUNT(DISTINCT CASE WHEN p THEN lower(v) END) AS distinct_ci,
    COUNT(CASE WHEN p AND {email} THEN 1 END) AS n_email,
    COUNT(CASE WHEN p AND {phone} THEN 1 END) AS n_phone,
    COUNT(CASE WHEN p AND {cur_clean} <> '' AND {cur_clean} <> v AND {_duck_finite(cur_clean)} THEN 1 END) AS n_currency,
    COUNT(CASE WHEN p AND v LIKE '%\\%' ESCAPE '\\' AND {_duck_finite(pct_body)} THEN 1 END) AS n_percentage,
    COUNT(CASE WHEN p AND {num_clean} <> '' AND {_duck_finite(num_clean)} THEN 1 END) AS n_numeric,
    COUNT(CASE WHEN p AND {date_pred} THEN 1 END) AS n_date,
    COUNT(CASE WHEN p AND {boolean} THEN 1 END) AS n_boolean,
    MIN(CASE WHEN p AND {_duck_finite(num_clean)} THEN TRY_CAST({num_clean} AS DOUBLE) END) AS num_min,
    MAX(CASE WHEN p AND {_duck_finite(num_clean)} THEN TRY_CAST({num_clean} AS DOUBLE) END) AS num_max
  FROM (SELECT ordinal, "column", raw, trim(raw) AS v, raw IS NOT NULL AND trim(raw) <> '' AS p FROM ({long}))
  GROUP BY ordinal, "column")
"""


_TABLE_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}


@register("p03_profile", "\nUNION ALL\n".join(_duck_profile_sql(t, _TABLE_COLUMNS[t]) for t in PROFILE_TABLES))
def p03_profile(spark, base):
    parts = []
    for t in PROFILE_TABLES:
        prof = PF.profile(table(spark, base, t), with_samples=False)
        parts.append(prof.withColumn("table_name", F.lit(t)).select(*PROFILE_OUT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _samples_sql() -> str:
    long = " UNION ALL ".join(f"SELECT {i} AS ordinal, trim(CAST({c} AS VARCHAR)) AS v FROM documents"
                              for i, c in enumerate(_DOCUMENT_COLUMNS))
    num = "TRY_CAST(trim(regexp_replace(v, '[$,]', '', 'g')) AS DOUBLE)"
    return f"""
WITH prof AS ({_duck_profile_sql("documents", _DOCUMENT_COLUMNS)}),
long AS (SELECT * FROM ({long}) WHERE v <> ''),
least AS (SELECT ordinal, min(v) AS m FROM long GROUP BY ordinal, substr(md5(v), 1, 1)),
five AS (SELECT ordinal, list_sort(list(m))[1:5] AS samples FROM least GROUP BY ordinal),
nums AS (SELECT ordinal, count(CASE WHEN isfinite({num}) THEN 1 END) AS num_count FROM long GROUP BY ordinal)
SELECT ordinal, "column", type, detected_type, num_min, num_max, coalesce(num_count, 0) AS num_count, samples
FROM prof LEFT JOIN five USING (ordinal) LEFT JOIN nums USING (ordinal)
"""


@register("p04_samples", _samples_sql())
def p04_samples(spark, base):
    """P4 + P17: sample values and numeric summary of the documents table."""
    prof = PF.profile(table(spark, base, "documents"))
    return prof.select("ordinal", "column", "type", "detected_type", "num_min", "num_max", "num_count", "samples")


@register("p05_types")
def p05_types(spark, base):
    """The other type detectors over events and labels."""
    parts = []
    for t in ("events", "labels", "orders"):
        prof = PF.profile(table(spark, base, t), with_samples=False)
        parts.append(prof.select(F.lit(t).alias("table_name"), "ordinal", "column", "metadata_type", "strict_type",
                                 "fine_type", "basic_type", "missing", "missing_pct", "distinct_raw"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- P7, P8

@register("p07_dup_rows", """
SELECT 'documents.text' AS scope, COUNT(*) AS rows, COUNT(DISTINCT text) + MAX(CASE WHEN text IS NULL THEN 1 ELSE 0 END)
       AS distinct_rows,
       COUNT(*) - (COUNT(DISTINCT text) + MAX(CASE WHEN text IS NULL THEN 1 ELSE 0 END)) AS duplicate_rows FROM documents
UNION ALL
SELECT 'orders', COUNT(*), (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders)),
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders)) FROM orders
""")
def p07_dup_rows(spark, base):
    d = PF.duplicate_rows(table(spark, base, "documents"), ["text"]).select(F.lit("documents.text").alias("scope"), "*")
    o = PF.duplicate_rows(table(spark, base, "orders")).select(F.lit("orders").alias("scope"), "*")
    return d.unionByName(o)


@register("p08_dup_cols", """
SELECT "column", duplicate_of FROM (
  SELECT 'l_qty_copy' AS "column", 'l_quantity' AS duplicate_of, bool_and(l_quantity IS NOT DISTINCT FROM l_quantity * 1) AS same FROM lineitem
  UNION ALL SELECT 'l_tax_scaled', 'l_tax', bool_and(l_tax * 2 IS NOT DISTINCT FROM l_tax) FROM lineitem
  UNION ALL SELECT 'l_tax_scaled', 'l_discount', bool_and(l_tax * 2 IS NOT DISTINCT FROM l_discount) FROM lineitem
  UNION ALL SELECT 'l_shipdate', 'l_orderkey', bool_and(epoch_us(l_shipdate) IS NOT DISTINCT FROM l_orderkey) FROM lineitem) WHERE same
""")
def p08_dup_cols(spark, base):
    li = table(spark, base, "lineitem").withColumn("l_qty_copy", F.col("l_quantity")) \
        .withColumn("l_tax_scaled", F.col("l_tax") * 2)
    return PF.duplicate_columns(li)


# ---------------------------------------------------------------- P13, P14, S7

_EVENT_SCHEMA = {"value": "numeric", "ts": "date", "event_type": "boolean", "props": "text"}


@register("p13_validate", """
SELECT COUNT(*) AS problem_count FROM events
WHERE event_type IS NOT NULL AND trim(event_type) <> ''
  AND NOT lower(trim(event_type)) IN ('true','false','yes','no','1','0','y','n')
""")
def p13_validate(spark, base):
    count, _ = PF.validate_rows(table(spark, base, "events"), _EVENT_SCHEMA, "event_id")
    return count


_BOOL_SQL = "lower(trim(event_type)) IN ('true','false','yes','no','1','0','y','n')"


def _dirty_events(spark, base):
    """Events with an amount made dirty by the row's id: no number, or blank."""
    k = F.col("event_id") % 7
    return table(spark, base, "events").withColumn("amount", F.when(k == 3, F.lit("n/a")).when(k == 5, F.lit("  ")).otherwise(
        F.concat(F.lit("$"), F.col("value").cast("string"))))


@register("p13_samples", f"""
SELECT event_id AS row_key, list_sort(list_filter([
         CASE WHEN event_id % 7 = 3 THEN 'amount:n/a:numeric' END,
         CASE WHEN NOT {_BOOL_SQL} THEN 'event_type:' || event_type || ':boolean' END
       ], lambda x: x IS NOT NULL)) AS problems
FROM events WHERE event_id % 7 = 3 OR NOT {_BOOL_SQL}
ORDER BY event_id LIMIT 5
""")
def p13_samples(spark, base):
    """The first problem rows with their problems."""
    _, sample = PF.validate_rows(_dirty_events(spark, base), {"amount": "numeric", "ts": "date", "event_type": "boolean"}, "event_id")
    return sample.select("row_key", F.array_sort(F.transform("problems", lambda p: F.concat_ws(":", p["column"], p["value"], p["expected_type"])))
                         .alias("problems"))


@register("p13_dirty", f"""
SELECT COUNT(*) AS problem_count FROM events WHERE event_id % 7 = 3 OR NOT {_BOOL_SQL}
""")
def p13_dirty(spark, base):
    count, _ = PF.validate_rows(_dirty_events(spark, base), {"amount": "numeric", "ts": "date", "event_type": "boolean"}, "event_id")
    return count


@register("p14_cells", """
SELECT event_id AS row_key, 'amount' AS "column", CASE WHEN event_id % 7 = 3 THEN 'n/a' ELSE '' END AS value,
       CASE WHEN event_id % 7 = 3 THEN 'Type Mismatch' ELSE 'Missing Value' END AS type,
       CASE WHEN event_id % 7 = 3 THEN 'n/a is not a number'
            ELSE 'amount has no value' END AS message
FROM events WHERE event_id % 7 IN (3, 5)
""")
def p14_cells(spark, base):
    return PF.validate_cells(_dirty_events(spark, base), {"amount": "Number"}, "event_id")


# ---------------------------------------------------------------- P15, P16, P19

@register("p15_summary", """
SELECT COUNT(*) AS rows,
  CAST(SUM((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL OR trim(o_orderstatus) = '')::INT
      + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT
      + (o_orderpriority IS NULL OR trim(o_orderpriority) = '')::INT) AS BIGINT) AS missing_cells,
  CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS duplicate_headers,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows
FROM orders
""")
def p15_summary(spark, base):
    return PF.dataset_summary(table(spark, base, "orders"))


@register("p15_bytes", """
WITH j AS (SELECT length('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
                || o_totalprice || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderpriority":"' || o_orderpriority || '"}') AS n
           FROM orders)
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS missing_cells, CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS duplicate_headers,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows, CAST(2 * SUM(n) AS BIGINT) AS estimated_bytes FROM j
""")
def p15_bytes(spark, base):
    return PF.dataset_summary(table(spark, base, "orders"), with_bytes=True)


@register("p16_report", """
WITH p AS (SELECT COUNT(*) AS pc FROM events
           WHERE event_type IS NOT NULL AND trim(event_type) <> ''
             AND NOT lower(trim(event_type)) IN ('true','false','yes','no','1','0','y','n'))
SELECT COUNT(*) AS rows, CAST(6 AS BIGINT) AS columns, (SELECT pc FROM p) AS problem_count,
       CAST(CASE WHEN (SELECT pc FROM p) > 0
                 THEN GREATEST(0, 100 - FLOOR((SELECT pc FROM p) / COUNT(*) * 100 + 0.5)) ELSE 100 END AS BIGINT)
       || '%' AS cleanliness
FROM events
""")
def p16_report(spark, base):
    e = table(spark, base, "events")
    count, _ = PF.validate_rows(e, _EVENT_SCHEMA, "event_id")
    return PF.quality_report(e, count.select("problem_count").scalar())

