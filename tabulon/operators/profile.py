"""Column profiling and data quality.

Shape of the job: a few scans, the same number at every size.  Text columns are
unpivoted to rows of (ordinal, column, raw value) inside the scan stage (a
pipelined ``explode``); equal short values are grouped first, and ONE
``groupBy(ordinal, column)`` over the values computes all predicate counts.  Typed
columns (without samples) are counted as they are, some columns an aggregate.
With samples, all columns go unpivoted through one such ``groupBy``.  Distinct counts
go through one deduplicating shuffle of (column, digest) rows of the texts and one of
(column, 64-bit word) rows of the others (exact) or an HLL sketch (``approx=True``),
never one ``count(distinct)`` per column (which Catalyst would expand per row).
Nested columns (arrays, maps, structs, binary) are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from .filters import kind_of

# Thresholds and labels of the type rules.
UPLOAD_THRESHOLD = 0.8          # P1 / P12
FINE_THRESHOLD = 0.75           # P11
METADATA_THRESHOLD = 0.9        # P5 (strictly greater)
CATEGORY_MAX_DISTINCT = 20      # P1 / P12
FINE_CATEGORY_MAX_DISTINCT = 15  # P11
CATEGORY_MAX_RATIO = 0.15
MAX_COLUMNS = 200
HIGH_CARDINALITY_MIN_ROWS = 5
HIGH_CARDINALITY_RATIO = 0.9
SAMPLE_VALUES = 5
CURRENCY_NAME_RE = r"(?i)price|cost|amount|revenue|salary|fee"
PERCENT_NAME_RE = r"(?i)percent|rate|%|ratio"
TIME_RE = r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s?[aApP][mM])?$"
# possessive quantifiers: one pass without backtracking, whatever the length
URL_RE = r"(?i)^(?:https?://.*|(?:[a-zA-Z0-9]++(?:-[a-zA-Z0-9]++)*+\.)++[a-z]{2,}(?::\d+)?(?:/.*)?)$"
STRICT_BOOLEAN_WORDS = ["true", "false", "yes", "no"]

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]


def long_values(df: DataFrame, columns: list[str] | None = None, ordinals: dict | None = None) -> DataFrame:
    """Unpivot to (ordinal, column, kind, raw) with raw the string form."""
    cols = profiled_columns(df) if columns is None else columns
    ords = ordinals or {c: i for i, c in enumerate(cols)}
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(ords[c]).alias("ordinal"), F.lit(c).alias("column"),
                             F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("raw"))
                    for c in cols])
    return df.select(F.explode(arr).alias("e")).select("e.*")


def _cnt(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def column_stats(long: DataFrame, with_samples: bool = True) -> DataFrame:
    """All per-column predicate counts in one grouped aggregate over one
    unpivot.  Parsed forms (timestamp, numbers) are computed once per value
    in a projection before the aggregate.  Typed columns use their type: a
    typed timestamp is its own date, typed numbers and booleans are never
    dates."""
    (step1, step2), aggs = _stats_exprs(with_samples)
    return long.select(*step1).select(*step2).groupBy("ordinal", "column", "kind").agg(*aggs)


def _by_kind(text: Column, number: Column, date: Column, boolean: Column) -> Column:
    """A predicate per column kind: regex rules only run on text columns;
    typed columns answer from their type."""
    k = F.col("kind")
    return (F.when(k == "string", text).when(k == "number", number).when(k == "date", date)
            .otherwise(boolean))


_COUNTED = ["n_email", "n_url", "n_phone", "n_currency", "n_percentage", "n_numeric", "n_date", "n_boolean",
            "md_boolean", "md_date", "md_currency_symbol", "md_numeric_any_symbol", "md_pct_suffix",
            "md_num_0_100", "md_numeric", "ui_boolean", "ui_date", "ui_time", "ui_percentage", "ui_currency",
            "ui_float", "ui_integer", "ui_num_plain", "st_boolean", "st_number", "st_date"]


def _stats_exprs(with_samples: bool, weighted: bool = False):
    """Two projections and the aggregates; ``weighted``: a row stands for ``n`` equal values."""
    raw, kind = F.col("raw"), F.col("kind")
    v = F.trim(raw)
    f, t_ = F.lit(False), F.lit(True)
    # step 1: parsed forms, once per value
    digit = v.rlike(r"\d")
    ts = (F.when(kind == "date", raw.cast("timestamp"))
          .when((kind == "string") & digit, P.parse_date_fast(v)))
    numeral = digit & v.rlike(P.NUMBER_CHARS_RE)
    num = F.when(kind == "string", F.when(numeral, P.numeric_value(v))).otherwise(P.js_number(raw))
    step1 = ["ordinal", "column", "kind", "raw", v.alias("v"), (raw.isNotNull() & (v != F.lit(""))).alias("p"),
             ts.alias("ts"), num.alias("num"), F.coalesce(digit, F.lit(False)).alias("has_digit"),
             F.coalesce(numeral, F.lit(False)).alias("numeral")]
    # step 2: one boolean per rule; text without a digit can be no number,
    # currency, percentage, phone number, time or date
    v, ts, num = F.col("v"), F.col("ts"), F.col("num")
    dg = F.col("has_digit")
    yr = F.year(ts)
    ui_clean = F.trim(F.regexp_replace(v, r"[$,%\s]", ""))
    ui_num = P.js_number(ui_clean)
    ui_pct = v.endswith("%") & P.is_finite_number(F.trim(F.regexp_replace(v, "%$", "")))
    strict_clean = F.trim(F.regexp_replace(raw, r"[$,]", ""))
    bool01 = raw.isin("1", "0")
    whole = num == F.floor(num)
    preds = {
        "n_email": _by_kind(P.is_email(v), f, f, f),
        # URLs have no blanks; the gate also keeps the pattern off long prose
        "n_url": _by_kind(~v.rlike(r"\s") & v.rlike(URL_RE), f, f, f),
        "n_phone": _by_kind(P.is_phone(v), P.is_phone(v), f, f),
        "n_currency": _by_kind(P.is_currency(v), f, f, f),
        "n_percentage": _by_kind(P.is_percentage(v), f, f, f),
        "n_numeric": _by_kind(num.isNotNull() & (F.trim(F.regexp_replace(v, r"[$,]", "")) != F.lit("")),
                              num.isNotNull(), f, f),
        "n_date": _by_kind(P.is_date_str(v, ts=ts), f, yr.between(2000, 2100), f),
        "n_boolean": _by_kind(P.is_boolean_str(v), bool01, f, t_),
        "md_boolean": _by_kind(P.md_is_boolean(v), bool01, f, t_),
        "md_date": _by_kind(P.md_is_date(v, ts=ts), f, yr.between(1000, 3000), f),
        "md_currency_symbol": _by_kind(P.md_is_currency_symbol(v), f, f, f),
        "md_numeric_any_symbol": _by_kind(P.md_is_numeric_any_symbol(v), num.isNotNull(), f, f),
        "md_pct_suffix": _by_kind(P.md_is_pct_suffix(v), f, f, f),
        "md_num_0_100": _by_kind(P.md_is_num_0_100(v), num.between(0, 100), f, f),
        "md_numeric": _by_kind(P.md_is_numeric(v), num.isNotNull(), f, f),
        "ui_boolean": _by_kind(P.is_boolean_str(v), bool01, f, t_),
        "ui_date": _by_kind(~v.rlike(P.SHORT_NUMBER_RE) & ts.isNotNull(), f, ts.isNotNull(), f),
        "ui_time": _by_kind(v.rlike(TIME_RE), f, f, f),
        "ui_percentage": _by_kind(ui_pct, f, f, f),
        "ui_currency": _by_kind(P.is_currency(v), f, f, f),
        "ui_float": _by_kind(ui_num.isNotNull() & (ui_num != F.floor(ui_num)), num.isNotNull() & ~whole, f, f),
        "ui_integer": _by_kind(ui_num.isNotNull() & (ui_num == F.floor(ui_num)), num.isNotNull() & whole, f, f),
        "ui_num_plain": _by_kind(ui_num.isNotNull(), num.isNotNull(), f, f),
        "st_boolean": _by_kind(F.lower(raw).isin(STRICT_BOOLEAN_WORDS), f, f, t_),
        "st_number": _by_kind((strict_clean != F.lit("")) & P.js_number(strict_clean).isNotNull(),
                              num.isNotNull(), f, f),
        "st_date": _by_kind((F.length(raw) >= 6) & P.js_number(raw).isNull() & ts.isNotNull(), f,
                            ts.isNotNull(), f),
    }
    numbers = {"n_currency", "n_percentage", "n_numeric", "md_currency_symbol", "md_numeric_any_symbol", "md_pct_suffix", "md_num_0_100", "md_numeric",
               "ui_percentage", "ui_currency", "ui_float", "ui_integer", "ui_num_plain", "st_number"}
    gates = dict.fromkeys(["n_phone", "n_date", "md_date", "ui_date", "ui_time", "st_date"], (F.col("kind") != "string") | dg)
    gates |= dict.fromkeys(numbers, (F.col("kind") != "string") | F.col("numeral"))
    if weighted:
        step1.append("n")
    step2 = ["ordinal", "column", "kind", "raw", "v", "p", "num", "ts", *(["n"] if weighted else []), F.when(F.col("p"), F.substring(F.md5("v"), 1, 1)).alias("digit")] + \
        [(F.col("p") & F.coalesce(F.when(gates[k], preds[k]) if k in gates else preds[k], F.lit(False)))
         .alias(k) for k in _COUNTED]
    def count_if(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long") if weighted else F.count_if(cond)
    aggs = [count_if(F.lit(True)).alias("rows"), count_if(~F.col("p")).alias("missing"),
            count_if(F.col("p")).alias("non_empty")]
    aggs += [count_if(F.col(k)).alias(k) for k in _COUNTED if k != "ui_num_plain"]
    aggs.append((count_if(F.col("ui_percentage")) + count_if(F.col("ui_currency")) + count_if(F.col("ui_num_plain")))
                .alias("ui_numeric"))
    pn = F.when(F.col("p"), F.col("num"))
    aggs.append(F.sum(F.when(F.col("p"), F.length("v") * F.col("n") if weighted else F.length("v"))).alias("len_sum"))
    aggs += [F.min(pn).alias("num_min"), F.max(pn).alias("num_max"), count_if(pn.isNotNull()).alias("num_count")]
    day = F.when(F.col("p"), F.col("ts"))
    aggs += [F.min(day).alias("date_min"), F.max(day).alias("date_max")]
    if with_samples:
        # the sketch of lengths also makes this an object-hash aggregate;
        # smallest strings alone would sort all rows first
        aggs.append(F.percentile_approx(F.when(F.col("p"), F.length("v")), 0.5, 100).alias("len_median"))
        aggs.append(sample_values_expr(F.col("v"), F.col("digit")).alias("samples"))
    return (step1, step2), aggs


#: characters of a text that is grouped before the rules look at it
SHORT_TEXT = 256


def text_stats(long: DataFrame) -> DataFrame:
    """The counts of ``column_stats`` (without samples) for text columns.  The rules
    are far dearer than a group, so equal short values meet first and a value is
    looked at once, with its number of rows; longer ones are not shuffled."""
    short = F.coalesce(F.length("raw") <= SHORT_TEXT, F.lit(True))
    names = ["ordinal", "column", "kind", "raw"]
    values = long.filter(short).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    values = values.unionByName(long.filter(~short).select(*names, F.lit(1).cast("long").alias("n")))
    (step1, step2), aggs = _stats_exprs(False, True)
    return values.select(*step1).select(*step2).groupBy("ordinal", "column", "kind").agg(*aggs)


#: typed columns counted in one aggregate
TYPED_COLUMNS = 4


def typed_stats(df: DataFrame, columns: list[str], ordinals: dict[str, int]) -> DataFrame:
    """The counts of ``column_stats`` (without samples) for columns that are numbers,
    dates or booleans by type: no text rule can hold for them, so they are
    counted as they are, in aggregates that read the columns once."""
    zero = F.lit(0).cast("long")

    def stats(c: str) -> Column:
        kind, dtype, col = kind_of(df.schema[c].dataType), df.schema[c].dataType, F.col(c)
        num, ts, n = F.lit(None).cast("double"), F.lit(None).cast("timestamp"), F.count(c)
        counts = dict.fromkeys(_COUNTED, zero)
        if kind == "number":
            whole_type = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            num = (col.cast("string") if isinstance(dtype, T.FloatType) else col).cast("double")
            num = F.when(F.abs(num) < F.lit(float("inf")), num)
            flag = phone = F.lit(False)
            if whole_type:  # seven characters or more, a sign counts
                flag, phone = col.isin(0, 1), (col >= 1_000_000) | (col <= -100_000)
            elif isinstance(dtype, T.DecimalType) and dtype.scale == 0:
                flag, phone = col.isin(0, 1), F.length(col.cast("string")).between(7, 20)
            counts |= dict.fromkeys(["n_boolean", "md_boolean", "ui_boolean"], F.count_if(flag))
            counts |= dict.fromkeys(["n_numeric", "md_numeric", "md_numeric_any_symbol", "ui_num_plain", "st_number"], F.count(num))
            counts |= {"n_phone": F.count_if(phone), "md_num_0_100": F.count_if(num.between(0, 100)),
                       "ui_integer": F.count_if(num == F.floor(num)), "ui_float": F.count_if(num != F.floor(num))}
        elif kind == "date":
            ts = col.cast("timestamp")
            counts |= {"n_date": F.count_if(F.year(ts).between(2000, 2100)), "md_date": F.count_if(F.year(ts).between(1000, 3000)), "ui_date": n, "st_date": n}
        else:
            counts |= dict.fromkeys(["n_boolean", "md_boolean", "ui_boolean", "st_boolean"], n)
        rows = F.count(F.lit(1))
        fields = {"ordinal": F.lit(ordinals[c]), "column": F.lit(c), "kind": F.lit(kind), "rows": rows, "missing": rows - n, "non_empty": n,
                  **{k: v for k, v in counts.items() if k != "ui_num_plain"}, "ui_numeric": counts["ui_num_plain"], "len_sum": F.lit(None).cast("long"),
                  "num_min": F.min(num), "num_max": F.max(num), "num_count": F.count(num), "date_min": F.min(ts), "date_max": F.max(ts)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    out = None
    for at in range(0, len(columns), TYPED_COLUMNS):
        some = columns[at:at + TYPED_COLUMNS]
        row = df.agg(*[stats(c).alias(f"c{i}") for i, c in enumerate(some)])
        part = row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(some))])))
        out = part if out is None else out.unionByName(part)
    return out


def all_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every column: text by the rules, the others by their type."""
    ordinals = {c: i for i, c in enumerate(columns)}
    text = [c for c in columns if kind_of(df.schema[c].dataType) == "string"]
    typed = [c for c in columns if c not in text]
    parts = [typed_stats(df, typed, ordinals)] if typed else []
    if text:
        parts.append(text_stats(long_values(df, text, ordinals)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out


def distinct_counts(long: DataFrame, approx: bool = False) -> DataFrame:
    """(ordinal, column, distinct_ci, distinct_raw): distinct non-empty
    values, case-insensitive and trimmed (P3) and as stored (P5, P11, P12).

    Exact mode shuffles 128-bit digests of the values, not the values: one
    exchange deduplicates (column, folded digest, digest) triples (map-side
    combined, so a hot value costs one row per partition), and both counts
    come from that set.  Approx mode shuffles only HLL sketches."""
    raw = F.col("raw")
    present = long.filter(raw.isNotNull() & (F.trim(raw) != F.lit("")))
    if approx:
        return present.groupBy("ordinal", "column").agg(
            F.approx_count_distinct(F.lower(F.trim(raw))).alias("distinct_ci"),
            F.approx_count_distinct(raw).alias("distinct_raw"))
    # typed values have one spelling
    folded = F.when(F.col("kind") == "string", F.lower(F.trim(raw))).otherwise(raw)
    d = present.select("ordinal", "column", digest(folded).alias("folded"), digest(raw).alias("exact")).distinct()
    per = d.groupBy("ordinal", "column", "folded").agg(F.count(F.lit(1)).alias("spellings"))
    return per.groupBy("ordinal", "column").agg(F.sum("spellings").alias("distinct_raw"), F.count(F.lit(1)).alias("distinct_ci"))


#: types of at most 64 bits, whose 64-bit hash is one-to-one
_WORDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _word(df: DataFrame, column: str) -> Column:
    """64 bits that differ where the string forms of a column's values do."""
    c, dtype = F.col(column), df.schema[column].dataType
    if isinstance(dtype, T.TimestampType):  # its string form is the local time
        c = c.cast("timestamp_ntz")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):  # the hash holds zeros equal, their string forms differ
        return F.when((c == 0) & c.cast("string").startswith("-"), F.xxhash64(F.lit("-0.0"))).when(c.isNotNull(), F.xxhash64(c.cast("double")))
    return F.when(c.isNotNull(), F.xxhash64(c))


def all_distinct(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """``distinct_counts`` of every column; typed values of at most 64 bits are
    shuffled as one word each and never become strings."""
    ordinals = {c: i for i, c in enumerate(columns)}
    words = [] if approx else [c for c in columns if isinstance(df.schema[c].dataType, _WORDS)]
    rest = [c for c in columns if c not in words]
    parts = [distinct_counts(long_values(df, rest, ordinals), approx)] if rest else []
    if words:
        pairs = F.array(*[F.struct(F.lit(ordinals[c]).alias("ordinal"), _word(df, c).alias("word")) for c in words])
        d = df.select(F.explode(pairs).alias("e")).select("e.*").filter(F.col("word").isNotNull()).distinct()
        per = d.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_raw"))
        name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("ordinal"))
        parts.append(per.select("ordinal", name.alias("column"), "distinct_raw", F.col("distinct_raw").alias("distinct_ci")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def digest(v: Column) -> Column:
    """128 bits that stand for a value in a shuffle."""
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("tabulon"), v).alias("b"))


# Hash classes of the sample rule, the first hexadecimal digit of the MD5
SAMPLE_CLASSES = "0123456789abcdef"


def sample_values_expr(v: Column, digit: Column, k: int = SAMPLE_VALUES) -> Column:
    """P4 as an aggregate: the smallest value of each of 16 hash classes, and
    of those the k smallest, sorted.  The rule is order-based and mergeable,
    so the samples are the same for any partitioning and any size, and it
    runs inside the same grouped aggregate as the other counts; the
    reference's "first 100 rows" has no meaning for unordered data."""
    least = F.array(*[F.min(F.when(digit == c, v)) for c in SAMPLE_CLASSES])
    return F.slice(F.array_sort(F.array_compact(least)), 1, k)


def with_whole_samples(long: DataFrame, stats: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Where values share hash classes and fewer than k were sampled, the
    smallest of the column's other distinct values are added, up to k."""
    # the median of lengths (null without values) keeps this an object-hash aggregate, see _stats_exprs
    few = stats.filter((F.size("samples") < k) & (F.col("len_median") > 0)).select("ordinal", "samples")
    # at most a row per column: broadcast, or a column's values would all meet in one task
    rest = (long.select("ordinal", F.trim("raw").alias("v")).filter(F.col("v") != "")
            .join(F.broadcast(few), "ordinal").filter(~F.array_contains("samples", F.col("v"))).select("ordinal", "v").distinct())
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy("v"))
    more = rest.withColumn("k", rank).filter(F.col("k") <= k).groupBy("ordinal").agg(F.array_sort(F.collect_list("v")).alias("more"))
    whole = F.array_sort(F.concat("samples", F.slice("more", 1, F.greatest(F.lit(0), F.lit(k) - F.size("samples")))))
    return stats.join(more, "ordinal", "left").withColumn("samples", F.coalesce(whole, "samples")).drop("more")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _cardinality_class(d: Column) -> Column:
    return (F.when(d <= 2, F.lit("binary")).when(d <= 10, F.lit("low"))
            .when(d < 50, F.lit("medium")).otherwise(F.lit("high")))


def upload_types(compat_order: bool = False, distinct_col: str = "distinct_ci") -> tuple[Column, Column]:
    """(type, detected_type) from the counts.

    The reference tests phone before date, so ISO date strings become phone
    numbers; by default date is tested right after e-mail (``compat_order``
    restores the reference order)."""
    ne = F.col("non_empty")

    def hit(c):
        return (ne > 0) & (F.col(c) / ne >= F.lit(UPLOAD_THRESHOLD))
    order = [("n_email", "text", "Email"), ("n_phone", "text", "Phone Number"),
             ("n_currency", "numeric", "Currency"), ("n_percentage", "numeric", "Percentage"),
             ("n_numeric", "numeric", "Number"), ("n_date", "date", "Date"),
             ("n_boolean", "boolean", "Boolean")]
    if not compat_order:
        order = [order[0], order[5]] + order[1:5] + order[6:]
    d = F.col(distinct_col)
    cat = (d <= CATEGORY_MAX_DISTINCT) | (_ratio(d, F.col("rows")) <= CATEGORY_MAX_RATIO)
    t = F.when(ne == 0, F.lit("text"))
    dt = F.when(ne == 0, F.lit("Text"))
    for c, ty, det in order:
        t, dt = t.when(hit(c), F.lit(ty)), dt.when(hit(c), F.lit(det))
    t = t.when(cat, F.lit("categorical")).otherwise(F.lit("text"))
    dt = dt.when(cat, F.lit("Category")).otherwise(F.lit("Text"))
    return t, dt


def metadata_type() -> Column:
    """P5: boolean (all) -> date -> currency -> percentage -> numeric (> 90 %)
    -> text; currency and percentage also look at the column name."""
    ne = F.col("non_empty")

    def over(c):
        return (ne > 0) & (F.col(c) / ne > F.lit(METADATA_THRESHOLD))
    name = F.col("column")
    cur = F.when(name.rlike(CURRENCY_NAME_RE), over("md_numeric_any_symbol")).otherwise(over("md_currency_symbol"))
    pct = over("md_pct_suffix") | (name.rlike(PERCENT_NAME_RE) & over("md_num_0_100"))
    return (F.when(ne == 0, F.lit("text"))
            .when(F.col("md_boolean") == ne, F.lit("boolean"))
            .when(over("md_date"), F.lit("date"))
            .when(cur, F.lit("currency"))
            .when(pct, F.lit("percentage"))
            .when(over("md_numeric"), F.lit("numeric"))
            .otherwise(F.lit("text")))


def strict_type() -> Column:
    """P10: every value must match; boolean -> number -> date -> string."""
    ne = F.col("non_empty")
    return (F.when(ne == 0, F.lit("string"))
            .when(F.col("st_boolean") == ne, F.lit("boolean"))
            .when(F.col("st_number") == ne, F.lit("number"))
            .when(F.col("st_date") == ne, F.lit("date"))
            .otherwise(F.lit("string")))


def fine_type() -> Column:
    """75 % rule over Boolean, Date, Time, Percentage, Currency, Float,
    Integer, Numeric, then Category / Text."""
    ne = F.col("non_empty")

    def hit(c):
        return (ne > 0) & (F.col(c) / ne >= F.lit(FINE_THRESHOLD))
    d = F.col("distinct_raw")
    out = F.when(ne == 0, F.lit("Text"))
    for c, lbl in [("ui_boolean", "Boolean"), ("ui_date", "Date"), ("ui_time", "Time"),
                   ("ui_percentage", "Percentage"), ("ui_currency", "Currency"), ("ui_float", "Float"),
                   ("ui_integer", "Integer"), ("ui_numeric", "Numeric")]:
        out = out.when(hit(c), F.lit(lbl))
    cat = (d <= FINE_CATEGORY_MAX_DISTINCT) | (_ratio(d, F.col("rows")) <= CATEGORY_MAX_RATIO)
    return out.when(cat, F.lit("Category")).otherwise(F.lit("Text"))


def profile(df: DataFrame, approx: bool = False, compat_order: bool = False,
            with_samples: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row per column (the column profile).

    Columns: ordinal, column, kind, rows, missing, missing_pct, non_empty,
    distinct_ci, distinct_raw, null_ratio, unique_ratio, cardinality_count,
    cardinality_class, the predicate counts, type, detected_type,
    metadata_type, strict_type, fine_type, basic_type, num_min, num_max,
    num_count, high_cardinality, samples."""
    cols = columns or profiled_columns(df)
    if with_samples:
        long = long_values(df, cols)
        stats = with_whole_samples(long, column_stats(long, True))
    else:
        stats = all_stats(df, cols)
    st = stats.join(all_distinct(df, cols, approx), ["ordinal", "column"], "left")
    return with_types(st.fillna(0, ["distinct_ci", "distinct_raw"]), compat_order)


def with_types(st: DataFrame, compat_order: bool = False) -> DataFrame:
    """The types and ratios that follow from a column's counts."""
    t, dt = upload_types(compat_order)
    _, basic = upload_types(True, "distinct_raw")
    ne, rows = F.col("non_empty"), F.col("rows")
    # typed (Parquet) columns keep their type; the text rules are for text
    kind = F.col("kind")
    typed = (ne > 0) & kind.isin("date", "number", "boolean")
    t = F.when(typed, F.create_map(F.lit("date"), F.lit("date"), F.lit("number"), F.lit("numeric"),
                                   F.lit("boolean"), F.lit("boolean"))[kind]).otherwise(t)
    dt = F.when(typed, F.create_map(F.lit("date"), F.lit("Date"), F.lit("number"), F.lit("Number"),
                                    F.lit("boolean"), F.lit("Boolean"))[kind]).otherwise(dt)
    out = st.select(
        "*",
        P.js_round(_ratio(rows - ne, rows), 4).alias("null_ratio"),
        P.js_round(_ratio(F.col("distinct_ci"), ne), 4).alias("unique_ratio"),
        F.col("distinct_ci").alias("cardinality_count"),
        _cardinality_class(F.col("distinct_ci")).alias("cardinality_class"),
        (F.col("missing") / F.greatest(rows, F.lit(1)) * F.lit(100.0)).alias("missing_pct"),
        t.alias("type"), dt.alias("detected_type"), metadata_type().alias("metadata_type"),
        strict_type().alias("strict_type"), fine_type().alias("fine_type"),
        basic.alias("basic_type"),
        ((rows > HIGH_CARDINALITY_MIN_ROWS) & (_ratio(F.col("distinct_ci"), rows) >= HIGH_CARDINALITY_RATIO))
        .alias("high_cardinality"),
    )
    return out


# ------------------------------------------------------------------ P7 P8 P9

def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows - distinct rows.  One groupBy over a 128-bit digest of all
    columns with map-side combine (long texts are not shuffled); output one
    row (rows, distinct_rows, duplicate_rows)."""
    cols = columns or df.columns
    # a null mask tells null from any value (a hash skips nulls)
    mask = F.array(*[F.col(c).isNull() for c in cols])
    row = F.struct(mask.alias("m"), F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("tabulon"), *cols).alias("b"))
    g = df.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
                 F.count(F.lit(1)).alias("distinct_rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _norm(df: DataFrame, c: str) -> Column:
    k = kind_of(df.schema[c].dataType)
    if k == "number":
        return F.col(c).cast("double")
    if k == "date":
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("string")


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns equal to an earlier column in every row.

    Pass 1 fingerprints every column in one aggregate (null count and an
    order-free XOR of value hashes) and returns one row whose size is bounded
    by the column count; pass 2 verifies only the pairs with equal
    fingerprints, in one aggregate of null-safe equality.  Both passes are
    single scans.  Output (column, duplicate_of)."""
    cols = columns or profiled_columns(df)
    kinds = {c: kind_of(df.schema[c].dataType) for c in cols}
    fp = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("n"),
                           F.bit_xor(F.xxhash64(_norm(df, c))).alias("h")).alias(f"f{i}")
                  for i, c in enumerate(cols)]).first()
    cand = [(i, j) for i in range(len(cols)) for j in range(i)
            if kinds[cols[i]] == kinds[cols[j]] and tuple(fp[i]) == tuple(fp[j])]
    empty = df.sparkSession.createDataFrame([], "column string, duplicate_of string")
    if not cand:
        return empty
    verify = df.agg(*[F.bool_and(F.coalesce(_norm(df, cols[i]).eqNullSafe(_norm(df, cols[j])), F.lit(False)))
                      .alias(f"p{k}") for k, (i, j) in enumerate(cand)])
    eq = verify.select(F.inline(F.array(*[
        F.struct(F.lit(cols[i]).alias("column"), F.lit(j).alias("j"), F.lit(cols[j]).alias("duplicate_of"),
                 F.col(f"p{k}").alias("eq")) for k, (i, j) in enumerate(cand)])))
    eq = eq.filter("eq")
    first = eq.groupBy("column").agg(F.min(F.struct("j", "duplicate_of")).alias("m"))
    return first.select("column", F.col("m.duplicate_of").alias("duplicate_of"))


def duplicate_headers(names: list[str]) -> list[str]:
    """Header names repeated after lower+trim (schema only)."""
    seen, dups = set(), []
    for n in names:
        k = n.lower().strip()
        if k in seen:
            dups.append(n)
        seen.add(k)
    return dups


# ------------------------------------------------------------------ P13 P14

def _type_problem(v: Column, typ: str) -> Column:
    """True when a present value does not fit the declared type."""
    if typ == "numeric":
        return ~P.is_numeric_str(v)
    if typ == "date":
        return ~P.is_date_str(v)
    if typ == "boolean":
        return ~P.is_boolean_str(v)
    return F.lit(False)


def validate_rows(df: DataFrame, schema: dict[str, str], row_key: str, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows with at least one value that does not fit its column type
    (numeric / date / boolean; empty cells are fine).

    Returns (count_df, samples_df): one row with problem_count, and up to
    ``samples`` problem rows (lowest ``row_key``) with their problems."""
    probs = F.filter(F.array(*[
        F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") &
               _type_problem(F.col(c).cast("string"), t),
               F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                        F.lit(t).alias("expected_type")))
        for c, t in schema.items()]), lambda x: x.isNotNull())
    bad = df.select(F.col(row_key).alias("row_key"), probs.alias("problems")).filter(F.size("problems") > 0)
    count = bad.agg(F.count(F.lit(1)).alias("problem_count"))
    sample = bad.orderBy("row_key").limit(samples)
    return count, sample


_EXPECTED = {
    "Number": "a number", "Currency": "a currency formatted string",
    "Percentage": "a percentage (e.g. 50%)", "Date": "a valid date",
    "Boolean": "a boolean value (true/false, yes/no)", "Email": "a valid email address",
    "Phone Number": "a valid phone number",
}


def _cell_invalid(v: Column, typ: str) -> Column:
    if typ == "Number":
        return ~P.is_numeric_str(v)
    if typ == "Currency":
        return ~P.is_currency(v) & ~P.is_numeric_str(v)
    if typ == "Percentage":
        return ~P.is_percentage(v) & ~P.is_numeric_str(v)
    if typ == "Date":
        return ~P.is_date_str(v)
    if typ == "Boolean":
        return ~P.is_boolean_str(v)
    if typ == "Email":
        return ~P.is_email(v)
    if typ == "Phone Number":
        return ~P.is_phone(v)
    return F.lit(False)


def validate_cells(df: DataFrame, column_types: dict[str, str], row_key: str) -> DataFrame:
    """One record per missing or mismatching cell:
    (row_key, column, value, type, message)."""
    recs = []
    for c, t in column_types.items():
        raw = F.col(c).cast("string")
        miss = raw.isNull() | (F.trim(raw) == "")
        bad = ~miss & _cell_invalid(raw, t)
        msg_missing = F.lit(f"{c} has no value")
        msg_bad = F.format_string(
            f"%s is not {_EXPECTED.get(t, '')}", raw)
        recs.append(F.when(miss, F.struct(F.lit(c).alias("column"), F.lit("").alias("value"),
                                          F.lit("Missing Value").alias("type"), msg_missing.alias("message")))
                    .when(bad, F.struct(F.lit(c).alias("column"), raw.alias("value"),
                                        F.lit("Invalid Date" if t == "Date" else "Type Mismatch").alias("type"),
                                        msg_bad.alias("message"))))
    arr = F.filter(F.array(*recs), lambda x: x.isNotNull())
    return df.select(F.col(row_key).alias("row_key"), F.explode(arr).alias("e")) \
        .select("row_key", "e.column", "e.value", "e.type", "e.message")


# ------------------------------------------------------------------ P15 P16 P19 P20

def dataset_summary(df: DataFrame, with_bytes: bool = False) -> DataFrame:
    """P15 + P19: rows, columns, missing cells, duplicate rows, duplicate
    header names; optional byte estimate (2 x JSON length of the rows)."""
    cols = df.columns
    missing = sum(F.count_if(P.is_missing(c)) for c in cols) if cols else F.lit(0)
    aggs = [F.count(F.lit(1)).alias("rows"), missing.cast("long").alias("missing_cells")]
    if with_bytes:
        aggs.append((F.sum(F.length(F.to_json(F.struct(*cols)))) * 2).cast("long").alias("estimated_bytes"))
    base = df.agg(*aggs)
    dups = duplicate_rows(df).select("duplicate_rows")
    out = base.withColumn("columns", F.lit(len(cols)).cast("long")) \
        .withColumn("duplicate_headers", F.lit(len(duplicate_headers(cols))).cast("long")) \
        .withColumn("duplicate_rows", dups.select(F.first("duplicate_rows")).scalar())
    return out


def quality_report(df: DataFrame, problem_count: Column | None = None) -> DataFrame:
    """Rows, columns, problem count, cleanliness
    ``max(0, 100 - round(problems / rows * 100))`` % (100 % without problems)."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("rows"))
    pc = F.coalesce(problem_count, F.lit(0)) if problem_count is not None else F.lit(0)
    clean = F.when(pc > 0, F.greatest(F.lit(0), F.lit(100) - F.floor(pc / F.col("rows") * 100 + F.lit(0.5))))\
        .otherwise(F.lit(100))
    return row.select("rows", F.lit(len(df.columns)).cast("long").alias("columns"),
                      pc.cast("long").alias("problem_count"),
                      F.concat(clean.cast("long").cast("string"), F.lit("%")).alias("cleanliness"))


def first_rows(df: DataFrame, order_key: str, n: int = 5) -> DataFrame:
    """P20 / S3 preview: the first n rows by a key."""
    return df.orderBy(order_key).limit(n)


def check_guards(df: DataFrame, max_columns: int = MAX_COLUMNS) -> list[str]:
    """Empty table, no headers, too many columns (schema + isEmpty)."""
    errs = []
    if not df.columns:
        errs.append("No column headers detected in the uploaded file")
    if len(df.columns) > max_columns:
        errs.append(f"The dataset exceeds the maximum allowable column count of {max_columns}")
    if df.columns and df.isEmpty():
        errs.append("The uploaded file contains no data rows")
    return errs
