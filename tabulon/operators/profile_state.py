"""Column profiles that are kept per part and joined (P1, P3-P6, P10-P12 under S8 append).

A part's state has one row per column: the counts of the profile, smallest and
largest numbers and dates, the smallest value of every hash class, and sketches
of the distinct values (HLL) and of the numbers (KLL); and one row (column null)
with the number of rows.  States of parts are joined by sums, minima, maxima and
sketch unions, so an append reads its own rows alone, and the profile of a
dataset of any number of parts reads states, never rows.

Counts, minima, maxima, types by share of rows and sample values are exactly those of
a profile of all rows.  Distinct counts are estimates with a relative standard error
of 0.6 %, exact up to some thousand values; the median is that of a number whose rank
is within 1.5 % of the middle (both with more than 99 % probability within three
times that)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profile as PF
from .filters import kind_of

#: log2 of the HLL buckets, size of the KLL sketch
HLL_BITS, KLL_SIZE = 15, 200
_COUNTS = ["rows", "missing", "non_empty", *[c for c in PF._COUNTED if c != "ui_num_plain"], "ui_numeric", "len_sum", "num_count"]
_LEAST, _MOST = ["num_min", "date_min"], ["num_max", "date_max"]
STATE = T.StructType([T.StructField("column", T.StringType()), T.StructField("kind", T.StringType()),
                      *[T.StructField(c, T.LongType()) for c in _COUNTS],
                      *[T.StructField(c, T.DoubleType()) for c in ("num_min", "num_max")],
                      *[T.StructField(c, T.TimestampType()) for c in ("date_min", "date_max")],
                      *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("least", "samples")],
                      *[T.StructField(c, T.BinaryType()) for c in ("hll_ci", "hll_raw", "kll")]])


def part_state(df: DataFrame) -> DataFrame:
    """The state of one part: STATE rows, one per profiled column and one for the part."""
    long = PF.long_values(df) if PF.profiled_columns(df) else None
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select(*[F.col("rows").alias(f.name) if f.name == "rows" else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields])
    if long is None:
        return rows
    (step1, step2), aggs = PF._stats_exprs(True)
    present = F.col("p")
    folded = F.when(F.col("kind") == "string", F.lower("v")).otherwise(F.col("raw"))
    classes = F.array(*[F.min(F.when(F.col("digit") == c, F.col("v"))) for c in PF.SAMPLE_CLASSES])
    aggs = [*aggs, classes.alias("least"), F.hll_sketch_agg(F.when(present, folded), F.lit(HLL_BITS)).alias("hll_ci"),
            F.hll_sketch_agg(F.when(present, F.col("raw")), F.lit(HLL_BITS)).alias("hll_raw"),
            F.kll_sketch_agg_double(F.when(present, F.col("num")), F.lit(KLL_SIZE)).alias("kll")]
    stats = long.select(*step1).select(*step2).groupBy("ordinal", "column", "kind").agg(*aggs)
    stats = PF.with_whole_samples(long, stats)
    return rows.unionByName(stats.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE.fields]))


def merged(states: DataFrame) -> DataFrame:
    """States of several parts as one: STATE rows."""
    one = states.filter(F.col("column").isNotNull())
    by_class = F.array(*[F.min(F.get("least", F.lit(i))) for i in range(len(PF.SAMPLE_CLASSES))])
    g = one.groupBy("column").agg(
        F.min("kind").alias("kind"), *[F.sum(c).cast("long").alias(c) for c in _COUNTS], *[F.min(c).alias(c) for c in _LEAST], *[F.max(c).alias(c) for c in _MOST],
        by_class.alias("least"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))).alias("samples"),  # at most five a part
        F.hll_union_agg("hll_ci").alias("hll_ci"), F.hll_union_agg("hll_raw").alias("hll_raw"), F.kll_merge_agg_double("kll").alias("kll"))
    first = F.slice(F.array_sort(F.array_compact("least")), 1, PF.SAMPLE_VALUES)
    rest = F.array_except("samples", first)
    g = g.withColumn("samples", F.array_sort(F.concat(first, F.slice(rest, 1, F.greatest(F.lit(0), F.lit(PF.SAMPLE_VALUES) - F.size(first))))))
    rows = states.filter(F.col("column").isNull()).agg(F.sum("rows").alias("rows"))
    rows = rows.select(*[F.col("rows").alias(f.name) if f.name == "rows" else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields])
    return rows.unionByName(g.select(*[f.name for f in STATE.fields]))


def _estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("long")


def profile_of(states: DataFrame, schema: T.StructType) -> DataFrame:
    """The column profile (as ``profile.profile``, with num_median) of the dataset
    whose parts have these states; columns and their order by ``schema``.  A
    column that a part lacks is missing in the part's rows."""
    spark = states.sparkSession
    names = [f for f in schema.fields if not isinstance(f.dataType, PF._NESTED)]
    order = spark.createDataFrame([(i, f.name, kind_of(f.dataType)) for i, f in enumerate(names)], "ordinal int, column string, kind string")
    m = merged(states)
    total = m.filter(F.col("column").isNull()).select(F.coalesce(F.max("rows"), F.lit(0)).cast("long")).scalar()
    st = order.join(m.filter(F.col("column").isNotNull()).drop("kind"), "column", "left")
    st = st.fillna(0, [c for c in _COUNTS if c != "len_sum"]).withColumn("rows", total).withColumn("missing", total - F.col("non_empty"))
    st = st.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    median = F.when(F.col("num_count") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(0.5)))
    st = st.withColumn("distinct_ci", _estimate("hll_ci")).withColumn("distinct_raw", _estimate("hll_raw")).withColumn("num_median", median)
    return PF.with_types(st.drop("least", "hll_ci", "hll_raw", "kll"))
