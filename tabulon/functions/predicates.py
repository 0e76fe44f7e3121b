"""Column-level value predicates and conversions (P2, P5 detectors, F12, X3-X6).

Every function takes and returns a ``Column`` built from Spark's own
functions, so the predicates run inside whole-stage codegen on the executors.
ANSI mode stays on: all conversions go through ``try_*`` and never throw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules for equal results.
# ---------------------------------------------------------------------------
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_RE = r"^\+?[\d\s\-()]{7,20}$"
CURRENCY_SYMBOLS = "$€£¥₽₨₹"  # $ € £ ¥ ₽ ₨ ₹
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
BOOLEAN_TRUE_WORDS = ["true", "yes", "1", "y"]
METADATA_BOOLEAN_WORDS = ["true", "false", "yes", "no", "0", "1"]
MONTH_NAME_RE = r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_SEPARATOR_RE = r"\d{1,4}[/\-.]\d{1,2}"
ISO_PREFIX_RE = r"^\d{4}-\d{2}-\d{2}"
SHORT_NUMBER_RE = r"^\d{1,4}$"
# Date formats tried in order after the ISO forms; month-first wins over
# day-first when both fit.
DATE_FORMATS = [
    "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy.M.d", "yyyy/M/d",
    "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "MMM yyyy",
]

_CUR_CLASS = "[" + CURRENCY_SYMBOLS.replace("$", r"\$") + "]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """Trimmed string form of a value; blank strings become null."""
    return F.nullif(F.trim(col_(c).cast("string")), F.lit(""))


def is_missing(c) -> Column:
    """Null, empty or whitespace-only."""
    c = col_(c)
    return c.isNull() | (F.trim(c.cast("string")) == F.lit(""))


# Shape of a decimal number literal; only such text is handed to the cast
# (a failed string-to-double cast is expensive in Spark).
NUMBER_SHAPE_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# The characters that a number can have, with all symbols that a rule strips;
# text with any other one is no number under any rule.
NUMBER_CHARS_RE = r"^[0-9+\-.eE%,\s" + CURRENCY_SYMBOLS.replace("$", r"\$") + "]*+$"


def js_number(s) -> Column:
    """``Number(s)`` restricted to finite decimal values; null otherwise."""
    c = col_(s).cast("string")
    v = F.when(c.rlike(NUMBER_SHAPE_RE), c.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def is_finite_number(s) -> Column:
    return js_number(s).isNotNull()


# ------------------------- upload-time predicates (P2) ----------------------

def is_numeric_str(s) -> Column:
    clean = F.trim(F.regexp_replace(col_(s).cast("string"), r"[$,]", ""))
    return F.coalesce((clean != F.lit("")) & is_finite_number(clean), F.lit(False))


def numeric_value(s) -> Column:
    """The cast used for numeric columns: strip ``$`` and ``,`` then parse."""
    return js_number(F.trim(F.regexp_replace(col_(s).cast("string"), r"[$,]", "")))


def is_email(s) -> Column:
    return F.coalesce(F.trim(col_(s).cast("string")).rlike(EMAIL_RE), F.lit(False))


def is_phone(s) -> Column:
    return F.coalesce(F.trim(col_(s).cast("string")).rlike(PHONE_RE), F.lit(False))


def is_currency(s) -> Column:
    t = F.trim(col_(s).cast("string"))
    clean = F.regexp_replace(t, _CUR_CLASS[:-1] + r",\s]", "")
    return F.coalesce((clean != F.lit("")) & (clean != t) & is_finite_number(clean), F.lit(False))


def is_percentage(s) -> Column:
    t = F.trim(col_(s).cast("string"))
    body = F.trim(F.regexp_replace(t, r"%$", ""))
    return F.coalesce(t.endswith("%") & is_finite_number(body), F.lit(False))


def is_boolean_str(s) -> Column:
    return F.coalesce(F.lower(F.trim(col_(s).cast("string"))).isin(BOOLEAN_WORDS), F.lit(False))


def boolean_value(s) -> Column:
    return F.lower(F.trim(col_(s).cast("string"))).isin(BOOLEAN_TRUE_WORDS)


# Shapes of the accepted date forms (ISO date/time, day-month-year with / or
# -, year.month.day, month names); text of any other shape cannot parse.
DATE_SHAPE_RE = (r"^\d{4}-\d{1,2}(-\d{1,2})?([T ].*)?$|^\d{1,2}[/-]\d{1,2}[/-]\d{4}$|"
                 r"^\d{4}[./]\d{1,2}[./]\d{1,2}$|^\d{1,2} [A-Za-z]{3,} \d{4}$|"
                 r"^[A-Za-z]{3,} \d{1,2},? \d{4}$|^[A-Za-z]{3,} \d{4}$")


def parse_date_fast(s) -> Column:
    """``parse_date`` only for text shaped like an accepted form.
    A failed formatted parse is expensive in Spark, so text that cannot
    match any format skips the format list entirely."""
    t = F.trim(col_(s).cast("string"))
    return F.when(t.rlike(DATE_SHAPE_RE), parse_date(t))


def parse_date(s) -> Column:
    """Parse a date/time string with the ISO forms first, then the format list."""
    t = F.trim(col_(s).cast("string"))
    tries = [F.try_to_timestamp(t)] + [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries)


def _date_shape(t: Column) -> Column:
    return t.rlike(DATE_SEPARATOR_RE) | t.rlike(ISO_PREFIX_RE) | t.rlike(MONTH_NAME_RE)


def is_date_str(s, min_year: int = 2000, max_year: int = 2100, ts: Column | None = None) -> Column:
    """Upload-time date test: not a short number, date-like shape, parses,
    year within [min_year, max_year].  ``ts`` may carry the parsed value
    when the caller has computed it already."""
    t = F.trim(col_(s).cast("string"))
    ts = parse_date_fast(t) if ts is None else ts
    # the parsed value first: the shapes are looked for in the whole text
    ok = ts.isNotNull() & F.year(ts).between(min_year, max_year) & (~t.rlike(SHORT_NUMBER_RE)) & _date_shape(t)
    return F.coalesce(ok, F.lit(False))


def date_value(s) -> Column:
    return parse_date(s)


# ---------------------- metadata-time predicates (P5) -----------------------

# Fixed values that must equal the reference's rules for equal results.
MD_SEPARATOR_FULL_RE = r"^\d{1,4}[/\-.]\d{1,2}([/\-.]\d{1,4})?$"
MD_ISO_TS_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def md_is_date(s, ts: Column | None = None) -> Column:
    t = F.trim(col_(s).cast("string"))
    shape = t.rlike(MD_SEPARATOR_FULL_RE) | t.rlike(MD_ISO_TS_RE) | t.rlike(MONTH_NAME_RE)
    ts = parse_date_fast(t) if ts is None else ts
    ok = ts.isNotNull() & F.year(ts).between(1000, 3000) & (~t.rlike(r"^\d+$")) \
        & (~t.rlike(r"[%" + CURRENCY_SYMBOLS.replace("$", r"\$") + "]")) & shape
    return F.coalesce(ok, F.lit(False))


def md_is_boolean(s) -> Column:
    return F.coalesce(F.lower(F.trim(col_(s).cast("string"))).isin(METADATA_BOOLEAN_WORDS), F.lit(False))


def _strip_symbols(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, _CUR_CLASS, ""), ",", ""))


def md_is_currency_symbol(s) -> Column:
    t = F.trim(col_(s).cast("string"))
    return F.coalesce(t.rlike(_CUR_CLASS) & is_finite_number(_strip_symbols(t)), F.lit(False))


def md_is_numeric_any_symbol(s) -> Column:
    t = F.trim(col_(s).cast("string"))
    c = _strip_symbols(t)
    return F.coalesce((c != F.lit("")) & is_finite_number(c), F.lit(False))


def md_is_pct_suffix(s) -> Column:
    return is_percentage(s)


def md_is_num_0_100(s) -> Column:
    v = js_number(F.trim(col_(s).cast("string")))
    return F.coalesce(v.between(0, 100), F.lit(False))


def md_is_numeric(s) -> Column:
    c = F.trim(F.regexp_replace(col_(s).cast("string"), ",", ""))
    return F.coalesce((c != F.lit("")) & is_finite_number(c), F.lit(False))


# ------------------------------ conversions ---------------------------------

# Fixed value: the numeric prefix of a text.
_FLOAT_PREFIX_RE = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)"


def parse_float(s) -> Column:
    """JavaScript ``parseFloat``: the longest numeric prefix, else null."""
    t = F.ltrim(col_(s).cast("string"))
    return js_number(F.nullif(F.regexp_extract(t, _FLOAT_PREFIX_RE, 0), F.lit("")))


def clean_number(s, bad_as_zero: bool = False) -> Column:
    """strip ``$ , %`` and spaces, parse; bad values null (or 0)."""
    v = js_number(F.regexp_replace(col_(s).cast("string"), r"[$,%\s]", ""))
    return F.coalesce(v, F.lit(0.0)) if bad_as_zero else v


def digits_only_number(s) -> Column:
    """UI KPI cleaning: everything but ``0-9 . -`` removed; bad -> 0."""
    v = js_number(F.nullif(F.regexp_replace(col_(s).cast("string"), r"[^0-9.\-]", ""), F.lit("")))
    return F.coalesce(v, F.lit(0.0))


def js_round(c, digits: int = 0) -> Column:
    """``Math.round(x * 10^d) / 10^d`` (halves go up, also for negatives).

    Written as ``floor(x * 10^d + 0.5) / 10^d`` so SQL engines reproduce the
    same double arithmetic exactly.  From 2^53 on, x * 10^d has no fraction
    left to round and the value is returned as it is.
    """
    x, p = col_(c).cast("double"), F.lit(float(10 ** digits))
    scaled = x * p
    return F.when(F.abs(scaled) < F.lit(EXACT_INTEGERS), floor_double(scaled + F.lit(0.5)) / p).otherwise(x)


# Doubles from here on are whole numbers.
EXACT_INTEGERS = float(2 ** 53)


def floor_double(x: Column) -> Column:
    """Floor of a double as a double (Spark's ``floor`` returns BIGINT, which
    saturates at 9.2e18); infinities and NaN stay."""
    return F.when(F.abs(x) < F.lit(EXACT_INTEGERS), F.floor(x).cast("double")).otherwise(x)


def all_of(cols) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def any_of(cols) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)
