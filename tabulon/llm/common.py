"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: words of a text: maximal runs without ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.
    Cuts the lineage: a lost executor never makes Spark run ``df`` again."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later
    step reads (its consumers have themselves been written)."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals out both sides by key and merges them.
    Left to itself Spark sends a side that it takes for small through the driver's
    memory.  It goes by the bytes of compressed files and counts an array as one
    element, so a table read back or exploded may be many times what it expects."""
    return df.hint("merge")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(n: int, size: int) -> int:
    """How many groups of about ``size`` rows ``n`` rows make (at least 1)."""
    return max(1, math.ceil(n / size))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (vectorised; wraps around)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from columns in the order of ``schema``."""
    arrays = []
    for f in schema:
        c = columns[f.name]
        arrays.append(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type, from_pandas=False))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32(doc_id as text) mod 5 = remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder
