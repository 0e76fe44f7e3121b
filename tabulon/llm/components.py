"""Connected components of a graph given by its edges, in Spark.

Alternating large-star and small-star steps (every node links its larger
neighbours, then all its smaller ones, to the smallest node it knows) until
the edges are stars around the smallest node of each component.  The smallest
neighbour is an aggregate, joined back to the edges, so a node with any number
of edges is never gathered in one task.  Every round is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import by_key, drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one type)
    that is not the smallest of its component; root is the smallest."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(by_key(least), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(by_key(low), "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = written(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        drop_written(e)
        before, state, e = state, _state(new), new
        if state == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
