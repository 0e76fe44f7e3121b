"""SQL oracles of the role queries.

Column types are derived in SQL from the cells themselves (text columns by
the P1 rules, typed columns by their type); roles, flags and rules follow as
CASE chains over the fixed pattern lists, which state the rule on both sides."""

from __future__ import annotations

from .profile_queries import _duck_profile_sql
from .recommend import semantics as S

# the profiled columns of the given tables: n number, d date, s text
COLUMNS = {
    "region": "r_regionkey:n r_name:s", "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n "
                "l_returnflag:s l_linestatus:s l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:s value:n props:s", "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n label:n", "pages": "page_id:n url:s html:s", "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n", "conversations": "conv_id:n turn:n role:s text:s",
}


def _profile_cte() -> str:
    parts = []
    for t, cols in COLUMNS.items():
        named = [c.split(":") for c in cols.split()]
        text = [c for c, k in named if k == "s"]
        place = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _) in enumerate(named)) + " END"
        if text:
            parts.append(f"SELECT '{t}' AS dataset_id, {place} AS ordinal, \"column\", type, rows, non_empty, distinct_ci FROM ({_duck_profile_sql(t, text)})")
        for i, (c, k) in enumerate(named):
            if k != "s":
                kind = "numeric" if k == "n" else "date"
                parts.append(f"SELECT '{t}', {i}, '{c}', CASE WHEN COUNT({c}) = 0 THEN 'text' ELSE '{kind}' END, COUNT(*), COUNT({c}), COUNT(DISTINCT {c}) FROM {t}")
    return " UNION ALL ".join(parts)


def _any(patterns: list[str]) -> str:
    """One of the patterns is in the name.  The SQL engine has no negative
    look-ahead: for ``x(?!y)`` every xy is blanked out before x is looked for."""
    plain = [p for p in patterns if "(?!" not in p]
    tests = ["regexp_matches(name, '" + "|".join(f"(?:{p})" for p in plain).replace("'", "''") + "')"]
    for p in patterns:
        if "(?!" in p:
            x, y = p[:-1].split("(?!")
            tests.append(f"regexp_matches(regexp_replace(name, '{x}(?:{y})', '#', 'g'), '{x}')")
    return "(" + " OR ".join(tests) + ")"


def sem_sql() -> str:
    """CTEs up to ``sem``: role, confidence and flags of every column."""
    number, text = "phys = 'number'", "phys = 'string'"
    rules = [
        (_any(S.IDENTIFIER_PATTERNS), S.IDENTIFIER, "0.97"), (_any(S.CONTACT_PATTERNS), S.CONTACT, "0.95"),
        (_any(S.SENSITIVE_PATTERNS), S.SENSITIVE, "0.95"),
        ("phys = 'date'", S.TEMPORAL, "0.99"), (_any(S.TEMPORAL_PATTERNS), S.TEMPORAL, "0.88"), ("phys = 'boolean'", S.STATUS, "0.92"),
        (f"{number} AND {_any(S.PERCENTAGE_PATTERNS)}", S.PERCENTAGE, "0.93"), (f"{number} AND {_any(S.ORDINAL_PATTERNS)}", S.ORDINAL, "0.92"),
        (f"{number} AND {_any(S.DEMOGRAPHIC_PATTERNS)}", S.DEMOGRAPHIC, "0.95"), (f"{number} AND {_any(S.MONETARY_PATTERNS)}", S.MONETARY, "0.9"),
        (f"{number} AND {_any(S.ADDITIVE_PATTERNS)}", S.ADDITIVE, "0.88"), (f"{number} AND {_any(S.RATIO_PATTERNS)}", S.RATIO, "0.85"),
        (f"{number} AND ur > 0.95 AND card > 20", S.IDENTIFIER, "0.8"), (f"{number} AND class IN ('low', 'binary')", S.ORDINAL, "0.65"),
        (number, S.ADDITIVE, "0.7"),
        (f"{text} AND {_any(S.STATUS_PATTERNS)}", S.STATUS, "0.92"), (f"{text} AND {_any(S.GEOGRAPHIC_PATTERNS)}", S.GEOGRAPHIC, "0.9"),
        (f"{text} AND ur > 0.95 AND card > 50", S.TEXT, "0.78"),
        (f"{text} AND (type IN ('categorical', 'boolean') OR class IN ('binary', 'low', 'medium'))", S.CATEGORICAL, "0.82"),
        (text, S.TEXT, "0.7"),
    ]
    role = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in rules)
    sure = " ".join(f"WHEN {c} THEN {x}" for c, _, x in rules)
    hidden = f"semantic_role IN ('{S.IDENTIFIER}', '{S.CONTACT}', '{S.SENSITIVE}')"
    sensitive = f"semantic_role IN ('{S.SENSITIVE}', '{S.CONTACT}')"
    temporal = f"(semantic_role = '{S.TEMPORAL}' OR type = 'date')"
    return f"""
prof AS ({_profile_cte()}),
facts AS (SELECT *, lower(trim("column")) AS name, distinct_ci AS card,
    FLOOR(CAST(distinct_ci AS DOUBLE) / GREATEST(non_empty, 1) * 10000.0 + 0.5) / 10000.0 AS ur,
    CASE WHEN distinct_ci <= 2 THEN 'binary' WHEN distinct_ci <= 10 THEN 'low' WHEN distinct_ci < 50 THEN 'medium' ELSE 'high' END AS class,
    CASE type WHEN 'date' THEN 'date' WHEN 'boolean' THEN 'boolean' WHEN 'numeric' THEN 'number' ELSE 'string' END AS phys FROM prof),
roles AS (SELECT *, CASE {role} ELSE '{S.UNKNOWN}' END AS semantic_role, CAST(CASE {sure} ELSE 0.3 END AS DOUBLE) AS confidence FROM facts),
sem AS (SELECT dataset_id, ordinal, "column", type, phys AS physical_type, semantic_role, confidence,
    semantic_role IN ('{S.MONETARY}', '{S.ADDITIVE}') AS is_additive,
    NOT {hidden} AND NOT {temporal} AND phys = 'number' AND semantic_role <> '{S.UNKNOWN}' AS is_aggregatable,
    NOT {hidden} AND NOT {temporal} AND (semantic_role IN ('{S.CATEGORICAL}', '{S.GEOGRAPHIC}', '{S.STATUS}')
        OR type IN ('categorical', 'boolean') OR class <> 'high') AS is_dimensionalizable,
    {temporal} AS is_temporal, {hidden} AS is_identifier, {sensitive} AS is_sensitive FROM roles)"""


ROLES_SQL = f"""
WITH {sem_sql()}
SELECT * FROM sem
"""


def _rules_cte() -> str:
    lst = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    rows = " UNION ALL ".join(f"SELECT '{r}' AS role, {lst(a)} AS allowed, {lst(f)} AS forbidden, CAST({repr(d) if d else 'NULL'} AS VARCHAR) AS def"
                              for r, (a, _, f, d) in S.AGGREGATION_RULES.items())
    syn = "CASE lower(trim(aggregation)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.AGGREGATION_SYNONYMS.items()) + " ELSE lower(trim(aggregation)) END"
    return f"rules AS ({rows}), checked AS (SELECT s.*, r.role, r.allowed, r.forbidden, r.def, {syn} AS agg FROM specs s LEFT JOIN rules r ON r.role = s.semantic_role)"


_VALID = "role IS NOT NULL AND NOT list_contains(forbidden, agg) AND (list_contains(allowed, agg) OR agg = 'none')"
_REASON = """CASE WHEN role IS NULL THEN 'no rules for the role ' || semantic_role
     WHEN list_contains(forbidden, agg) THEN agg || ' makes no sense for columns of the role ' || semantic_role
     WHEN list_contains(allowed, agg) OR agg = 'none' THEN agg || ' suits the role ' || semantic_role
     ELSE agg || ' is none of the aggregates for the role ' || semantic_role || ': ' || array_to_string(allowed, ', ') END"""

RULES_SQL = f"""
WITH {sem_sql()},
specs AS (SELECT dataset_id, "column", semantic_role, unnest(['sum', 'Average', 'count distinct', 'median', 'none', 'trend']) AS aggregation FROM sem),
{_rules_cte()}
SELECT dataset_id, "column", semantic_role, aggregation, {_VALID} AS valid, {_REASON} AS reason,
       CASE WHEN role IS NULL THEN 'count' WHEN {_VALID} THEN NULL ELSE def END AS suggested FROM checked
"""

_EXCLUDED = ", ".join(f"'{r}'" for r in S.KPI_EXCLUDED_ROLES)

EXTERNAL_SQL = f"""
WITH {sem_sql()},
asked AS (SELECT dataset_id, "column", unnest(['sum', 'avg', 'count_distinct']) AS aggregation FROM sem
          UNION ALL SELECT dataset_id, "column" || '_missing', 'sum' FROM sem),
specs AS (SELECT a.*, s.semantic_role FROM asked a LEFT JOIN sem s USING (dataset_id, "column")),
{_rules_cte()},
judged AS (SELECT *, CASE WHEN semantic_role IS NULL THEN 'no such column'
    WHEN semantic_role IN ({_EXCLUDED}) THEN 'columns of the role ' || semantic_role || ' make no KPI'
    WHEN NOT ({_VALID}) THEN {_REASON} END AS rejected_reason FROM checked)
SELECT dataset_id, "column", agg AS aggregation, semantic_role, rejected_reason IS NULL AS accepted, rejected_reason FROM judged
"""

SERIES_KIND_SQL = f"""
WITH {sem_sql()}
SELECT dataset_id, "column" AS x_field, CASE WHEN is_aggregatable THEN 'none' ELSE 'sum' END AS aggregation,
       CASE WHEN is_aggregatable THEN 'scatter'
            WHEN type = 'date' OR semantic_role = '{S.TEMPORAL}'
              OR regexp_matches(lower("column"), 'date|time|day|month|year|timestamp|created_at|updated_at|period') THEN 'temporal'
            ELSE 'category' END AS series_kind FROM sem
"""


# ---------------------------------------------------------------- R6, R7, R8

def _group_cte() -> str:
    """CTEs up to ``grp``: every column's group, its share of nulls and class."""
    return sem_sql() + """,
grp AS (SELECT s.*, f.class, FLOOR(CAST(f.rows - f.non_empty AS DOUBLE) / GREATEST(f.rows, 1) * 10000.0 + 0.5) / 10000.0 AS nulls,
    CASE WHEN is_sensitive THEN 'ignored' WHEN is_temporal THEN 'temporal' WHEN is_identifier THEN 'identifier' WHEN is_aggregatable THEN 'measure'
         WHEN is_dimensionalizable THEN 'dimension' ELSE 'ignored' END AS grp
    FROM sem s JOIN facts f ON f.dataset_id = s.dataset_id AND f.ordinal = s.ordinal)"""


def _relationship_cte() -> str:
    parts = [  # type, block, x, y, value
        ("temporal-measure", 0, "temporal", "measure", f"LEAST(100, 85 + CASE y.semantic_role WHEN '{S.MONETARY}' THEN 10 WHEN '{S.ADDITIVE}' THEN 5 ELSE 0 END - CASE WHEN y.nulls > 0.3 THEN 10 ELSE 0 END)"),
        ("temporal-count", 0, "temporal", "_count", "70"),
        ("dimension-measure", 1, "dimension", "measure", "GREATEST(0, LEAST(100, 75 + CASE WHEN y.is_additive THEN 10 ELSE 0 END + CASE x.class WHEN 'low' THEN 8 WHEN 'medium' THEN 4 WHEN 'high' THEN -20 ELSE 0 END - CASE WHEN y.nulls > 0.3 THEN 8 ELSE 0 END))"),
        ("dimension-count", 1, "dimension", "_count", "CASE x.class WHEN 'binary' THEN 80 WHEN 'low' THEN 76 WHEN 'medium' THEN 72 ELSE 50 END"),
        ("measure-measure", 2, "measure", "measure", "65"), ("measure-distribution", 3, "measure", None, "60"), ("identifier-count", 4, "identifier", None, "80")]
    sql = []
    for typ, block, x, y, value in parts:
        if y == "measure":
            later = " AND x.ordinal < y.ordinal" if x == "measure" else ""
            rest = "y.\"column\" AS y_column, x.semantic_role AS x_role, y.semantic_role AS y_role"
            source, y_ord = f"grp x JOIN grp y ON x.dataset_id = y.dataset_id AND y.grp = 'measure'{later}", "y.ordinal"
        else:
            rest = f"{repr(y) if y else 'CAST(NULL AS VARCHAR)'} AS y_column, x.semantic_role AS x_role, CAST(NULL AS VARCHAR) AS y_role"
            source, y_ord = "grp x", "10000" if y else "-1"
        sql.append(f"SELECT x.dataset_id, '{typ}' AS type, x.\"column\" AS x_column, {rest}, {value} AS value, x.ordinal AS x_ordinal, {y_ord} AS y_ordinal, {block} AS block FROM {source} WHERE x.grp = '{x}'")
    return _group_cte() + f""",
pairs AS ({' UNION ALL '.join(sql)}),
rel AS (SELECT * EXCLUDE (block), ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY block, x_ordinal, y_ordinal) AS seq FROM pairs)"""


RELATIONSHIPS_SQL = f"WITH {_relationship_cte()} SELECT * FROM rel"

CAPABILITIES_SQL = f"""
WITH {_relationship_cte()},
r AS (SELECT rel.*, g.class FROM rel LEFT JOIN grp g ON g.dataset_id = rel.dataset_id AND g."column" = rel.x_column AND g.grp = 'dimension'),
n AS (SELECT dataset_id, COUNT(*) AS m FROM grp WHERE grp = 'measure' GROUP BY dataset_id)
SELECT dataset_id, 'time_series' AS capability, MAX(value) AS score, COUNT(*) AS count FROM r WHERE type = 'temporal-measure' GROUP BY 1
UNION ALL SELECT dataset_id, 'trend_analysis', 78, LEAST(COUNT(*), 2) FROM r WHERE type = 'temporal-measure' GROUP BY 1
UNION ALL SELECT dataset_id, 'breakdown', MAX(value), COUNT(*) FROM r WHERE type = 'dimension-measure' AND class <> 'high' GROUP BY 1
UNION ALL SELECT dataset_id, 'frequency', MAX(value), COUNT(*) FROM r WHERE type = 'dimension-count' GROUP BY 1
UNION ALL SELECT dataset_id, 'distribution', 62, m FROM n
UNION ALL SELECT dataset_id, 'correlation', 68, COUNT(*) FROM r WHERE type = 'measure-measure' GROUP BY 1
UNION ALL SELECT dataset_id, 'entity_count', 82, COUNT(*) FROM r WHERE type = 'identifier-count' GROUP BY 1
UNION ALL SELECT dataset_id, 'proportion', 75, COUNT(*) FROM r WHERE type = 'dimension-count' AND class IN ('binary', 'low') GROUP BY 1
"""


def _preferred(role: str, other: str) -> str:
    """The preferred aggregate of a role; one that is no aggregate becomes ``other``."""
    found = {r: d or (p[0] if p else "count") for r, (_, p, _, d) in S.AGGREGATION_RULES.items()}
    whens = " ".join(f"WHEN '{r}' THEN '{other if a in ('group_by', 'trend', 'date_grouping') else a}'" for r, a in found.items())
    return f"CASE {role} {whens} ELSE 'count' END"


def _intent_chart(typ: str, name: str, cap: int, agg: str, chart: str, primary: int | None, more: str = "TRUE", y: str = "y_column", order: str = "value DESC, seq") -> str:
    pri = f"CASE WHEN value >= {primary} THEN 'primary' ELSE 'secondary' END" if primary else "'secondary'"
    return f"""SELECT dataset_id, 'chart' AS kind, '{name}' AS type, x_column, {y} AS y_column, {agg} AS aggregation, '{chart}' AS chart_type, {pri} AS priority, value,
  y_role AS semantic_role, seq + 200000 AS seq FROM r WHERE type = '{typ}' AND {more} QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY {order}) <= {cap}"""


_ROLE_VALUE = "CASE semantic_role " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in S.KPI_ROLE_VALUE.items()) + " ELSE 50 END"

INTENTS_SQL = f"""
WITH {_relationship_cte()},
r AS (SELECT rel.*, g.class FROM rel LEFT JOIN grp g ON g.dataset_id = rel.dataset_id AND g."column" = rel.x_column AND g.grp = 'dimension')
SELECT dataset_id, 'kpi' AS kind, 'kpi_aggregate' AS type, "column" AS x_column, CAST(NULL AS VARCHAR) AS y_column, {_preferred('semantic_role', '')} AS aggregation,
       CAST(NULL AS VARCHAR) AS chart_type, CASE WHEN semantic_role IN ('{S.MONETARY}', '{S.ADDITIVE}') THEN 'primary' ELSE 'secondary' END AS priority, {_ROLE_VALUE} AS value,
       semantic_role, ordinal AS seq FROM grp WHERE is_aggregatable AND NOT is_identifier AND NOT is_sensitive AND NOT is_temporal AND {_preferred('semantic_role', '')} <> ''
UNION ALL SELECT dataset_id, 'kpi', 'kpi_entity_count', x_column, NULL, 'count_distinct', NULL, 'primary', value, '{S.IDENTIFIER}', seq + 100000 FROM rel WHERE type = 'identifier-count'
UNION ALL ({_intent_chart('temporal-measure', 'time_series', 4, _preferred('y_role', 'sum'), 'line', 90)})
UNION ALL ({_intent_chart('dimension-measure', 'categorical_breakdown', 5, _preferred('y_role', 'count'), 'bar', 78, "class <> 'high'")})
UNION ALL ({_intent_chart('dimension-count', 'frequency_distribution', 3, "'count'", 'bar', None)})
UNION ALL ({_intent_chart('dimension-count', 'proportion', 2, "'count'", 'pie', None, "class IN ('binary', 'low')")})
UNION ALL ({_intent_chart('measure-measure', 'correlation', 2, "'none'", 'scatter', None, order='seq')})
"""


# ---------------------------------------------------------------- R20, R23

def questions_sql(texts: list[str]) -> str:
    """The first metric, categories and date of every dataset in four sentences."""
    cols = ", ".join(f"('{t}', {i}, '{c}', '{k}')" for t, named in COLUMNS.items() for i, (c, k) in enumerate(x.split(":") for x in named.split()))
    q = [("c1",), ("m", "d"), ("m",), ("c2",)]
    filled = [f"printf('{t}', {', '.join(args)})" for t, args in zip(texts, q)]
    rows = " UNION ALL ".join(f"SELECT dataset_id, {i} AS position, {f} AS question FROM named" for i, f in enumerate(filled))
    return f"""
WITH cols(dataset_id, i, c, k) AS (VALUES {cols}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, k ORDER BY i) AS rk FROM cols),
first AS (SELECT dataset_id, MAX(c) FILTER (WHERE k = 'n' AND rk = 1) AS m, MAX(c) FILTER (WHERE k = 's' AND rk = 1) AS c1,
          MAX(c) FILTER (WHERE k = 's' AND rk = 2) AS c2, MAX(c) FILTER (WHERE k = 'd' AND rk = 1) AS d FROM ranked GROUP BY dataset_id),
named AS (SELECT dataset_id, COALESCE(m, 'sales') AS m, COALESCE(c1, 'region') AS c1, COALESCE(c2, c1, 'products') AS c2, COALESCE(d, 'month') AS d FROM first)
{rows}"""


def routing_sql(questions: str, kinds: dict, words: tuple[str, str, str], aggregates: list[tuple[str, str]]) -> str:
    """R20 over a CTE body ``questions`` (dataset_id, question_id, question): CTEs up to
    ``routed``.  ``kinds``: numbers, texts and dates of each dataset, in order."""
    cols = ", ".join(f"('{d}', '{kind}', {i}, '{c}')" for d, lists in kinds.items() for kind, cs in zip(("number", "text", "date"), lists) for i, c in enumerate(cs))

    def pick(kind: str) -> str:
        mine = f"FROM cols WHERE cols.d = q.dataset_id AND kind = '{kind}'"
        return f"COALESCE((SELECT arg_min(c, i) {mine} AND contains(lower(question), lower(c))), (SELECT arg_min(c, i) {mine}))"

    compare, top, asc = (w.removeprefix("(?i)") for w in words)
    agg = "CASE " + " ".join(f"WHEN regexp_matches(question, '{rx.removeprefix('(?i)')}', 'i') THEN '{n}'" for n, rx in reversed(aggregates)) + " ELSE 'sum' END"
    return f"""
cols(d, kind, i, c) AS (VALUES {cols}), q AS ({questions}),
named AS (SELECT *, {pick('number')} AS metric, {pick('text')} AS g, {pick('date')} AS dt FROM q),
judged AS (SELECT *, dt IS NOT NULL AND regexp_matches(question, '{compare}', 'i') AS compares, regexp_matches(question, '{top}', 'i') AS tops,
           regexp_matches(question, '{asc}', 'i') AS up, {agg} AS agg,
           COALESCE(TRY_CAST(regexp_extract(lower(question), '\\b([1-9]|10)\\b', 1) AS INT), 5) AS lim FROM named),
routed AS (SELECT dataset_id, question_id, CASE WHEN compares THEN 'compare_periods' WHEN tops THEN 'top_n' ELSE 'group_by' END AS action, metric,
           CASE WHEN NOT compares THEN g END AS group_by, CASE WHEN compares THEN dt END AS date_column, CASE WHEN compares THEN 'monthly' END AS period_type,
           CASE WHEN NOT compares AND tops THEN lim END AS "limit", CASE WHEN NOT compares AND tops THEN CASE WHEN up THEN 'asc' ELSE 'desc' END END AS direction,
           CASE WHEN NOT compares AND NOT tops THEN agg END AS aggregation FROM judged)"""


# the columns of three datasets by kind: numbers, texts, dates
KINDS = {t: tuple([c for c, k in (x.split(":") for x in COLUMNS[t].split()) if k == kind] for kind in "nsd") for t in ("orders", "lineitem", "events")}


# ---------------------------------------------------------------- R9, R10, R14, R15, R16

def _by_role(role: str, what) -> str:
    """CASE over the roles: what(allowed, preferred, forbidden, default) of each."""
    return f"CASE {role} " + " ".join(f"WHEN '{r}' THEN {what(*rule)}" for r, rule in S.AGGREGATION_RULES.items())


def _in(agg: str, names: list[str]) -> str:
    return f"{agg} IN ({', '.join(repr(n) for n in names)})" if names else "FALSE"


def _valid_sql(role: str, agg: str) -> str:
    return _by_role(role, lambda a, p, f, d: f"CASE WHEN NOT {_in(agg, f)} AND ({_in(agg, a)} OR {agg} = 'none') THEN {agg} ELSE {repr(d) if d else 'NULL'} END") + " ELSE 'count' END"


def _fit_sql(role: str, agg: str) -> str:
    return _by_role(role, lambda a, p, f, d: f"CASE WHEN {_in(agg, f)} THEN 0 WHEN {_in(agg, p)} THEN 100 WHEN {_in(agg, a)} THEN 70 ELSE 0 END") + " ELSE 0 END"


def _named(c: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def _case(of: str, values: dict, other) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {repr(v)}" for k, v in values.items()) + f" ELSE {repr(other)} END"


def _score(total: str) -> str:
    return f"CAST(FLOOR(LEAST(100.0, GREATEST(0.0, {total})) + 0.5) AS INT)"


def kpi_candidates_sql(formats: dict, worth: dict) -> str:
    return f"""
WITH i AS ({INTENTS_SQL}), {_group_cte().lstrip()},
missing AS (SELECT dataset_id, "column", (rows - non_empty) / GREATEST(rows, 1) * 100.0 AS pct FROM facts),
k AS (SELECT i.dataset_id, x_column, g.semantic_role, {_valid_sql('g.semantic_role', 'i.aggregation')} AS aggregation, priority, value AS relevance,
      GREATEST(0.0, 100.0 - pct * 1.5) AS quality, CASE WHEN g.is_sensitive THEN 'sensitive column' WHEN g.nulls > 0.6 THEN printf('%.1f%% missing values', g.nulls * 100) END AS rejected_reason, seq
      FROM i JOIN grp g ON g.dataset_id = i.dataset_id AND g."column" = i.x_column JOIN missing m ON m.dataset_id = i.dataset_id AND m."column" = i.x_column WHERE kind = 'kpi'),
u AS (SELECT *, CASE priority WHEN 'primary' THEN 90 ELSE 65 END AS useful FROM k WHERE aggregation IS NOT NULL)
SELECT dataset_id, x_column || '_' || aggregation AS kpi, x_column AS "column", aggregation,
       CASE WHEN aggregation IN ('count', 'count_distinct', 'sum') THEN 'Total ' || {_named('x_column')} WHEN aggregation = 'avg' THEN 'Average ' || {_named('x_column')}
            WHEN aggregation = 'max' THEN 'Maximum ' || {_named('x_column')} WHEN aggregation = 'min' THEN 'Minimum ' || {_named('x_column')} ELSE {_named('x_column')} || ' Overview' END AS title,
       {_case('semantic_role', formats, 'number')} AS format, semantic_role, priority, relevance, quality, rejected_reason, seq, 'universal' AS source,
       {_score(f"LEAST(100, relevance) * 0.25 + {_case('semantic_role', worth, 30)} * 0.20 + useful * 0.20 + {_fit_sql('semantic_role', 'aggregation')} * 0.15 + quality * 0.10 + useful * 0.05 + 80 * 0.05")} AS score
FROM u
"""


def chart_candidates_sql(worth: dict, fits: dict, most_slices: int, most_bars: int) -> str:
    valid = _valid_sql("y.semantic_role", "i.aggregation")
    fit = "CASE x_role " + " ".join(f"WHEN '{r}' THEN {_case('chart_type', m, 40)}" for r, m in fits.items()) + " ELSE 50 END"
    y = f"CASE WHEN y_column = '_count' OR y_column IS NULL THEN 'Count' ELSE {_named('y_column')} END"
    return f"""
WITH i AS ({INTENTS_SQL}), {_group_cte().lstrip()},
c AS (SELECT i.dataset_id, i.type AS intent_type, i.chart_type, i.x_column, i.y_column, x.semantic_role AS x_role, y.semantic_role AS y_role, i.priority, i.value AS relevance, i.seq,
      CASE WHEN y.semantic_role IS NULL OR i.aggregation = 'none' THEN i.aggregation WHEN {valid} IN ('group_by', 'trend', 'date_grouping') THEN 'count' ELSE {valid} END AS aggregation,
      GREATEST(0.0, 100.0 - (f.rows - f.non_empty) / GREATEST(f.rows, 1) * 100.0 * 1.5) AS quality,
      CASE WHEN x.is_sensitive THEN 'sensitive x column' WHEN i.chart_type = 'pie' AND f.card > {most_slices} THEN printf('pie with %d categories', f.card)
           WHEN i.chart_type = 'bar' AND NOT x.is_temporal AND f.card > {most_bars} THEN printf('bar with %d categories', f.card) END AS rejected_reason
      FROM i JOIN grp x ON x.dataset_id = i.dataset_id AND x."column" = i.x_column JOIN facts f ON f.dataset_id = i.dataset_id AND f."column" = i.x_column
      LEFT JOIN grp y ON y.dataset_id = i.dataset_id AND y."column" = i.y_column WHERE kind = 'chart'),
s AS (SELECT *, COALESCE(y_column, '_count') AS y_field, COALESCE(y_column, '_count') = '_count' OR aggregation = 'count' AS counts FROM c WHERE aggregation IS NOT NULL)
SELECT dataset_id, chart_type, x_column AS x_field, y_field, aggregation,
       CASE intent_type WHEN 'time_series' THEN {y} || ' Over Time' WHEN 'categorical_breakdown' THEN {y} || ' by ' || {_named('x_column')} WHEN 'frequency_distribution' THEN {_named('x_column')} || ' Distribution'
            WHEN 'proportion' THEN {_named('x_column')} || ' Breakdown' WHEN 'correlation' THEN {_named('x_column')} || ' vs ' || {y} ELSE {y} || ' by ' || {_named('x_column')} END AS title,
       x_role, y_role, intent_type, priority, relevance, quality, rejected_reason, seq, 'universal' AS source,
       {_score(f"CASE priority WHEN 'primary' THEN 90 ELSE 65 END * 0.25 + ({_case('x_role', worth, 30)} + CASE WHEN counts THEN 80 ELSE {_case('y_role', worth, 30)} END) / 2 * 0.20 + CASE priority WHEN 'primary' THEN 88 ELSE 62 END * 0.20 + CASE WHEN NOT counts AND y_role IS NOT NULL THEN {_fit_sql('y_role', 'aggregation')} ELSE 80 END * 0.15 + quality * 0.10 + {fit} * 0.05 + 80 * 0.05")} AS score
FROM s
"""
