"""Read the named parquet tables of a warehouse folder.

Every table is a plain ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; nothing is cached or collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, base: str, names=TABLES) -> None:
    """Register every table as a temp view (for SQL users)."""
    for n in names:
        table(spark, base, n).createOrReplaceTempView(n)
