"""Pages of a large ordered result (T4) without sorting all rows before them.

``next_page`` goes on from the last row seen: a filter on the order's columns and
an ordered limit.  ``PageIndex`` is for jumps: the rows are sorted once and
written, with the number of rows before each range of them; a page is then read from
the one or two ranges that hold it.  The sort works in parts of up to SORT_ROWS rows, so
its number of tasks and the sample that sets their bounds do not grow with the number
of ranges."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: rows a range
RANGE_ROWS = 1_000_000
#: rows that a task of the sort gets, at least a range
SORT_ROWS = 1_000_000
_ROW, _RANGE, _BLOCK = "_row", "_range", "_block"
#: monotonically_increasing_id counts a partition's rows in its lower 33 bits
_ROW_BITS = (1 << 33) - 1


def _order(keys: list[str]) -> list[tuple[str, bool]]:
    """Names and directions; a name that begins with - is descending."""
    return [(k[1:], False) if k.startswith("-") else (k, True) for k in keys]


def sort_columns(keys: list[str]) -> list[Column]:
    """Ascending with nulls first, descending with nulls last."""
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in _order(keys)]


def after(keys: list[str], last: dict) -> Column:
    """Rows that follow the one with these values in the order of ``keys``."""
    out, same = F.lit(False), F.lit(True)
    for c, up in _order(keys):
        col, v = F.col(c), last[c]
        if v is None:
            beyond = col.isNotNull() if up else F.lit(False)
        else:
            beyond = col > F.lit(v) if up else (col < F.lit(v)) | col.isNull()
        out = out | (same & beyond)
        same = same & col.eqNullSafe(F.lit(v))
    return out


def next_page(df: DataFrame, keys: list[str], last: dict | None, size: int = 10) -> DataFrame:
    """The ``size`` rows after the row with the values ``last`` (None: the first
    page).  The order must tell all rows apart, or equal ones are skipped."""
    rows = df if last is None else df.filter(after(keys, last))
    return rows.orderBy(*sort_columns(keys)).limit(size)


class PageIndex:
    """Rows of a result in ranges of its order, and where each range begins.

    Rows that the order does not tell apart are told apart by a number, so a
    value that a third of all rows share is cut into ranges as well."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema

    @classmethod
    def build(cls, df: DataFrame, keys: list[str], root: str | None = None, range_rows: int = RANGE_ROWS) -> PageIndex:
        """Sort and write once."""
        spark = df.sparkSession
        root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        out = cls(spark, root, keys, df.schema)
        numbered = df.withColumn(_ROW, F.monotonically_increasing_id())
        parts = max(1, math.ceil(df.count() / max(range_rows, SORT_ROWS)))
        order = [*sort_columns(keys), F.col(_ROW).asc()]
        at = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        (numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .withColumn(_RANGE, F.spark_partition_id()).withColumn(_BLOCK, F.floor(at / F.lit(range_rows)).cast("long"))
         .write.partitionBy(_RANGE).parquet(f"{root}/rows"))
        size = out._rows().groupBy(_RANGE, _BLOCK).agg(F.count(F.lit(1)).alias("n"))
        # one row per task of the sort
        before = F.coalesce(F.sum("m").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = size.groupBy(_RANGE).agg(F.sum("n").alias("m")).select(_RANGE, before.alias("before"))
        start = (F.col("before") + F.col(_BLOCK) * F.lit(range_rows)).cast("long").alias("start")
        size.join(F.broadcast(starts), _RANGE).select(_RANGE, _BLOCK, "n", start).write.parquet(f"{root}/index")
        return out

    def _rows(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(_ROW, T.LongType()), T.StructField(_BLOCK, T.LongType()), T.StructField(_RANGE, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def pages(self, size: int = 10) -> int:
        total = self.spark.read.parquet(f"{self.root}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return math.ceil(total / size)

    def page(self, number: int, size: int = 10) -> DataFrame:
        """Page ``number`` (from 1): the index is asked for the ranges that hold
        it, and only these are read and sorted."""
        begin = max(number - 1, 0) * size
        index = self.spark.read.parquet(f"{self.root}/index")
        held = index.filter((F.col("start") < begin + size) & (F.col("start") + F.col("n") > begin)).orderBy("start").collect()  # a page's ranges
        rows = self._rows()
        blocks = {}
        for r in held:
            blocks.setdefault(r[_RANGE], []).append(r[_BLOCK])
        here = F.lit(False)
        for part, some in blocks.items():
            here = here | ((F.col(_RANGE) == part) & F.col(_BLOCK).between(min(some), max(some)))
        rows = rows.filter(F.col(_RANGE).isin(list(blocks)) & here if held else F.lit(False))
        skip = begin - held[0]["start"] if held else 0
        return rows.orderBy(*sort_columns(self.keys), _ROW).offset(skip).limit(size).drop(_ROW, _RANGE, _BLOCK)
