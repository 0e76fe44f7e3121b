"""Filters, projections, sorting and paging.

Filters are plain ``Column`` predicates so Catalyst pushes what it can into
the parquet scan (equality and range predicates show up as PushedFilters).
Column names are resolved from the schema only; no data is read for that.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import all_of, any_of, col_, parse_date

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Limits used by the result views.
LIMITS = (5, 10, 15, 20, 50, 100, 150)
# Insight groups and the categories they show.
INSIGHT_GROUPS = {
    "highlights": ["trend", "growth", "performance", "peak", "summary"],
    "alerts": ["alert", "warning", "risk", "anomaly"],
    "recommendations": ["recommendation", "opportunity", "action"],
}


def kind_of(dt: T.DataType) -> str:
    """Coarse type of a Spark column: number, date, boolean or string."""
    if isinstance(dt, NUMERIC_TYPES):
        return "number"
    if isinstance(dt, DATE_TYPES):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "string"


def resolve_column(df: DataFrame, name: str | None, kinds: tuple[str, ...] | None = None,
                   fallback_first_of: str | None = None) -> str | None:
    """exact name, else case-insensitive, else (optionally) the first
    column of a wanted kind.  Schema lookup only."""
    fields = [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
    if name:
        clean = str(name).strip()
        for n, k in fields:
            if n == clean and (kinds is None or k in kinds):
                return n
        for n, k in fields:
            if n.lower() == clean.lower() and (kinds is None or k in kinds):
                return n
    if fallback_first_of:
        for n, k in fields:
            if k == fallback_first_of:
                return n
    return None


def equality_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """equality filters from a map; names matched case-insensitively,
    unknown names and empty values ignored; the key 'date' is not a column
    filter (see ``periods.relative_date_filter``)."""
    if not filters:
        return df
    conds = []
    lower = {c.lower(): c for c in df.columns}
    for k, v in filters.items():
        if v is None or v == "" or k == "date":
            continue
        c = lower.get(str(k).lower())
        if c is not None:
            lit = literal_for(df.schema[c].dataType, v)
            conds.append(F.lit(False) if lit is None else F.col(c) == F.lit(lit))
    return df.filter(all_of(conds)) if conds else df


def literal_for(dt: T.DataType, v):
    """A filter value as a value of the column's type, so that the comparison
    is pushed into the scan; None if it is no value of that type."""
    try:
        if isinstance(dt, T.BooleanType):
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).strip().lower())
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            d = Decimal(str(v).strip())
            return int(d) if d == d.to_integral_value() and abs(d) < 2**63 else None
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return float(str(v).strip())
        if isinstance(dt, T.DecimalType):
            return Decimal(str(v).strip())
        if isinstance(dt, T.DateType):
            return v if isinstance(v, date) else date.fromisoformat(str(v).strip())
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return v if isinstance(v, datetime) else datetime.fromisoformat(str(v).strip())
    except (ArithmeticError, ValueError):
        return None
    return str(v)


def combined_filters(df: DataFrame, filters: dict | None, date_col: str | None) -> DataFrame:
    """F1 + F2: a whole filter map.  The key 'date' (today / 7days / 30days)
    is a window on ``date_col`` that ends at the largest date of the dataset
    as given, not of the rows that the other filters leave."""
    from .periods import relative_date_filter
    window = (filters or {}).get("date")
    dated = relative_date_filter(df, date_col, window) if date_col and window else df
    return equality_filters(dated, filters)


def contains_all(df: DataFrame, terms: dict) -> DataFrame:
    """every listed column must contain its term (case-insensitive);
    null never matches; empty terms are ignored."""
    conds = [F.coalesce(F.lower(F.col(c).cast("string")).contains(str(t).lower()), F.lit(False))
             for c, t in terms.items() if t not in (None, "")]
    return df.filter(all_of(conds)) if conds else df


def contains_filter(df: DataFrame, column: str, term: str | None,
                    fallback_all: bool = False) -> DataFrame:
    """single case-insensitive 'contains' filter (null counts as '').

    With ``fallback_all`` and no matching row, all rows are kept, as the
    reference does; the check is an ``exists`` scalar subquery, no collect."""
    if not term:
        return df
    cond = F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).contains(str(term).lower())
    if not fallback_all:
        return df.filter(cond)
    any_match = df.filter(cond).select(F.lit(1)).limit(1).exists()
    return df.filter(cond | ~any_match)


def date_not_null(df: DataFrame, column: str, parse: bool = False) -> DataFrame:
    """not-null (and, for text, parseable) date filter."""
    c = F.col(column)
    return df.filter(parse_date(c).isNotNull() if parse else c.isNotNull())


def threshold(value, op: str, limit) -> Column:
    """``> < == !=`` (also >=, <=); unknown operators mean '>'."""
    v, t = col_(value), F.lit(limit) if not isinstance(limit, Column) else limit
    return {"<": v < t, "==": v == t, "=": v == t, "!=": v != t, ">=": v >= t, "<=": v <= t}.get(op, v > t)


def in_list(value, values: list) -> Column:
    """F8: IN-list condition."""
    return col_(value).isin(list(values))


def any_column_search(df: DataFrame, term: str | None, columns: list[str] | None = None) -> DataFrame:
    """keep rows where any column contains the term (case-insensitive)."""
    if not term:
        return df
    cols = columns or df.columns
    t = str(term).lower()
    return df.filter(any_of([F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
                             for c in cols]))


def capped_projection(df: DataFrame, x: str, y: str | None, cap: int = 100) -> DataFrame:
    """F10 + F13: raw (x, y) points without aggregation, capped.  Ordered by
    (x, y) first so the capped set is deterministic."""
    ycol = F.col(y) if y else F.lit(None)
    return df.select(F.col(x).alias("x"), ycol.alias("y")).orderBy("x", "y").limit(cap)


def insight_filter(df: DataFrame, group: str, category_col: str = "category") -> DataFrame:
    """keep insights whose category belongs to a group."""
    cats = INSIGHT_GROUPS.get(group)
    return df if cats is None else df.filter(F.lower(F.col(category_col)).isin(cats))


def mixed_sort_keys(column: str, ascending: bool = True, tie: str | None = None) -> list[Column]:
    """Numbers sort numerically, other values case-insensitively as text."""
    c = F.col(column)
    num = c.cast("string").try_cast("double")
    txt = F.lower(c.cast("string"))
    keys = [num.asc_nulls_last() if ascending else num.desc_nulls_last(),
            txt.asc_nulls_last() if ascending else txt.desc_nulls_last()]
    if tie:
        keys.append(F.col(tie).asc())
    return keys


def sort_mixed(df: DataFrame, column: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    return df.orderBy(*mixed_sort_keys(column, ascending, tie))


def sort_uploads(df: DataFrame, by: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """T5: an upload list by a count, a date or a text: numbers and dates in
    their own order, texts as T1 sorts them; nulls last either way."""
    if kind_of(df.schema[by].dataType) == "string":
        return sort_mixed(df, by, ascending, tie)
    c = F.col(by)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *([F.col(tie).asc()] if tie else []))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Ordered limit (runs as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, page_no: int, size: int = 10, *order: Column) -> DataFrame:
    """T4: one page (1-based) of an ordered result."""
    return df.orderBy(*order).offset(max(page_no - 1, 0) * size).limit(size)


def clamp_limit(n, lo: int = 1, hi: int = 20, default: int = 5) -> int:
    try:
        v = int(n)
    except (TypeError, ValueError):
        v = default
    if v == 0:
        v = default
    return min(max(v, lo), hi)
