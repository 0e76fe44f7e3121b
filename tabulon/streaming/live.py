"""Live versions of the time-bucket series (A10) and rule alerts
over a stream of event files (Structured Streaming).

Late rows are bounded by a watermark on the event time, windows are
event-time ``window()`` buckets, and state is kept by Spark's stateful
aggregation; checkpoints go to the shared folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import in_list, threshold
from ..operators.rules import Rule
from ..session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet",
                 max_files_per_trigger: int = 10) -> DataFrame:
    """Parquet files arriving in ``folder`` as a stream (explicit schema)."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ values are read as UTC instants (the
    session time zone is pinned to UTC)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _marked(stream: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """With a watermark; None if the stream has one already."""
    return stream if watermark is None else _event_time(stream, ts).withWatermark(ts, watermark)


def once_each(stream: DataFrame, event_id: str, ts: str, watermark: str = "1 day") -> DataFrame:
    """Events without those that were sent before (same id within the watermark);
    ones older than the watermark are dropped, sent before or not.  State is
    kept for the watermark's length only."""
    return _event_time(stream, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([event_id])


def windowed_series(stream: DataFrame, ts: str, value: str | None, agg: str = "sum", every: str = "1 day",
                    watermark: str | None = "1 day") -> DataFrame:
    """A10 live: per event-time window the aggregate and row count; the
    label is the window start formatted like the batch day bucket."""
    v = F.col(value) if value else F.lit(1.0)
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(agg)
    y = F.count(F.lit(1)).cast("double") if fn is None else fn(v).cast("double")
    g = _marked(stream, ts, watermark).groupBy(F.window(ts, every).alias("w")).agg(y.alias("y"), F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("x"), "y", "n",
                    F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


def windowed_alerts(stream: DataFrame, ts: str, rules: list[Rule], every: str = "1 day",
                    watermark: str | None = "1 day") -> DataFrame:
    """A22 live: matching rows per rule and window (rules with no match in a
    window are dropped)."""
    aggs = []
    for k, r in enumerate(rules):
        cond = threshold(r.column, r.operator, r.threshold)
        if r.in_column:
            cond = cond & in_list(r.in_column, r.in_values)
        aggs.append(F.count_if(cond).alias(f"n{k}"))
    g = _marked(stream, ts, watermark).groupBy(F.window(ts, every).alias("w")).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"n{k}").cast("long").alias("triggered_count"))
                    for k, r in enumerate(rules)])
    return g.select(F.col("w.start").alias("window_start"), F.inline(arr)).filter(F.col("triggered_count") > 0)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available now into a memory table and return it
    (for tests and one-shot catch-up runs)."""
    spark = df.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


class LiveTable:
    """A table of finished windows that grows as event files arrive: every
    ``catch_up`` processes the files that came since and appends the windows that
    the watermark has closed.  Files, table and checkpoint are in shared folders,
    so any driver can go on where the last one stopped."""

    def __init__(self, spark: SparkSession, folder: str, schema, make, max_files_per_trigger: int = 1000):
        self.spark, self.folder, self.schema, self.make, self.most = spark, folder, schema, make, max_files_per_trigger
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
        self.table, self.state = f"{root}/table", f"{root}/state"
        self.columns = None

    def catch_up(self) -> None:
        out = self.make(event_stream(self.spark, self.folder, self.schema, max_files_per_trigger=self.most))
        self.columns = out.schema
        q = (out.writeStream.format("parquet").outputMode("append").option("path", self.table).option("checkpointLocation", self.state)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(self.table)
