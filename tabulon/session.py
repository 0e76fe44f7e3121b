"""Spark session settings shared by the library, the tests and the bench.

On a cluster the session already exists and its settings win; ``get_session``
only fills in what is unset.  The settings that matter for results are pinned:
UTC session time zone (dates are bucketed in UTC) and ANSI mode left on, so all
parsing in the library goes through ``try_*`` functions.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that every plan relies on.  AQE coalesces the small shuffles of
# profile / KPI jobs and splits skewed partitions of the few real joins.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabulon") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in REQUIRED_CONF.items():
            if k == "spark.sql.session.timeZone":
                active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("TABULON_MASTER", "local[8]"))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    builder = builder.config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEM", "8g"))
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The setting ``spark.checkpoint.dir`` names it; else a folder the user has
    set in code (``setCheckpointDir``) is used.  Only a local master, where
    every task runs on this machine, gets a scratch folder when neither is
    set; on a cluster that is an error, since executors do not share /tmp.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabulon-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: it
    is computed once, and a lost executor never makes Spark compute it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
