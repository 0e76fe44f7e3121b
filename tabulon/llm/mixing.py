"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: shares of ``total`` x all words by
weight, at most ``most`` times the source's own words, the excess reshared by
weight until no target is above that.  With f = target / own words, every
document of the source is taken floor(f) times for certain; the fraction left
is its inclusion probability p.  A document draws U (a hash of its id, so that
reruns agree) and is ranked by Q = (U / (1 - U)) / (p / (1 - p)), random odds
over inclusion odds; the sample is the run of smallest Q whose words reach the
words left, so its size is fixed (in words, to within half a document).

The run's end is found without ranking a whole source in one task: Q is cut
into ``CELLS`` cells, words are summed per source and cell, only the cell that
holds the end is cut again, and only the rows of the last cell are ranked.

DataFrame operations only.  Results for odd input: a null text has size 0 and
nothing to take but its certain copies; a null source is a source of its own,
last in order; repeated rows are documents of their own that draw the same U
and are told apart by a row number (in :func:`mixed`, rows equal in id, source and
text count as one document); an empty table gives an empty result; other
columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
CELLS = 1024


def uniform(*key: Column, seed: int = 17) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12)).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).  Weights
    repeat over the sources in code-point order, null last.

    The level L solves sum(min(most * size, L * weight)) = total: capped
    sources are found by rounds of one aggregate each; the set only grows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = written(per.withColumn("weight", w), "sources")
    cap = F.lit(most) * F.col("source_size")
    all_words = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level, held = total * all_words, 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        n, capped, free = per.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not free:
            break
        held, level = n, max(0.0, goal - (capped or 0.0)) / free
    return per.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))
                          if free else cap)


def _reach(rows: DataFrame, low: Column, width: float, targets: DataFrame, done: DataFrame | None) -> DataFrame:
    """Per source, the first cell of ``rows`` at which the running words pass
    the words left, with the words of the cells before it."""
    cell = F.least(F.floor((F.col("u") - low) / F.lit(width)), F.lit(CELLS - 1)).cast("int")
    sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    t = targets.select(F.col("source").alias("s2"), "left")
    before = F.lit(0.0)
    s = sums.withColumn("run", run)
    if done is not None:
        s = s.join(done.select(F.col("source").alias("s3"), F.col("before").alias("b0")), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
        before = F.col("b0")
    s = s.join(t, F.col("source").eqNullSafe(F.col("s2")))
    hit = s.filter(before + F.col("run") >= F.col("left"))
    return hit.groupBy("source").agg(F.min(F.struct("cell", (before + F.col("run") - F.col("words")).alias("before"))).alias("x")).select("source", "x.cell", "x.before")


def mix_sources(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_hash, size,
    source_size, target, copies, taken (= copies x size)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = written(source_targets(base, weights, total, most)
                      .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
                      .withColumn("sure", F.floor(F.col("ratio") + F.lit(1e-12)))
                      .withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size")))
                      .withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure"))), "targets")
    drawn = base.withColumn("u", uniform(F.col("doc_id"), seed=seed))
    # within a source p is one number, so cells of U are cells of Q in the same order
    first = written(_reach(drawn, F.lit(0.0), 1.0 / CELLS, targets, None), "cells")
    within = _in_cell(drawn, first, 1.0 / CELLS)
    second = written(_reach(within, F.col("low"), 1.0 / CELLS**2, targets, first), "cells")
    last = _in_cell(within.drop("low", "cell", "before"), second, 1.0 / CELLS**2, first)
    odds = F.try_divide(F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p"))
    t = targets.select(F.col("source").alias("s2"), "left", "p")
    ranked = (last.join(t, F.col("source").eqNullSafe(F.col("s2"))).withColumn("q", odds)
              .withColumn("run", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0))))
    # the document that crosses the end is taken if that comes nearer to it
    ends = written(ranked.select("row", (F.col("run") - F.col("size") / 2 <= F.col("left")).alias("in_last")), "ends")
    e = first.select(F.col("source").alias("s4"), F.col("cell").alias("c1")).join(second.select(F.col("source").alias("s5"), F.col("cell").alias("c2")), F.col("s4").eqNullSafe(F.col("s5"))).drop("s5")
    out = drawn.join(targets.drop("weight").withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    out = out.join(e, F.col("source").eqNullSafe(F.col("s4")), "left").drop("s4").join(ends, "row", "left")
    low2 = F.col("c1") / CELLS + F.col("c2") / F.lit(float(CELLS**2))
    c1 = F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1))
    c2 = F.least(F.floor((F.col("u") - F.col("c1") / CELLS) * F.lit(float(CELLS**2))), F.lit(CELLS - 1))
    inside = (c1 < F.col("c1")) | ((c1 == F.col("c1")) & (c2 < F.col("c2")))
    copies = F.col("sure") + F.when(F.col("p") <= 0, F.lit(0)).when(F.col("c1").isNull(), F.lit(1)).when(F.col("in_last").isNotNull(), F.col("in_last").cast("int")).when(inside, F.lit(1)).otherwise(F.lit(0))
    return (out.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long"))
            .select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def _in_cell(rows: DataFrame, ends: DataFrame, width: float, outer: DataFrame | None = None) -> DataFrame:
    """The rows of the cell that holds their source's end, with the cell's
    low edge and the words before it."""
    e = ends.select(F.col("source").alias("s2"), "cell", "before")
    low = F.col("cell") * F.lit(width)
    if outer is not None:
        o = outer.select(F.col("source").alias("s3"), (F.col("cell") / CELLS).alias("low0"))
        e = e.join(o, F.col("s2").eqNullSafe(F.col("s3"))).drop("s3")
        low = F.col("low0") + low
    e = e.withColumn("low", low)
    cell = F.least(F.floor((F.col("u") - (F.col("low0") if outer is not None else F.lit(0.0))) / F.lit(width)), F.lit(CELLS - 1))
    same = rows.join(e, F.col("source").eqNullSafe(F.col("s2"))).filter(cell == F.col("cell"))
    return same.drop("s2", "cell", "low0") if outer is not None else same.drop("s2", "cell")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, with the
    columns of ``docs``."""
    m = mix_sources(docs, **options)
    per = m.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("__tb_c"), F.count("*").alias("__tb_n"))
    per = per.select(F.col("doc_id").alias("__tb_d"), F.col("source").alias("__tb_s"), F.col("text_hash").alias("__tb_h"), "__tb_c", "__tb_n").filter("__tb_c > 0")
    d = docs.withColumn("__tb_x", F.xxhash64("text"))
    j = d.join(per, F.col("doc_id").cast("long").eqNullSafe(F.col("__tb_d")) & F.col("source").eqNullSafe(F.col("__tb_s")) & (F.col("__tb_x") == F.col("__tb_h")))
    return _spread(j, docs)


def _spread(j: DataFrame, docs: DataFrame) -> DataFrame:
    """Repeat rows: a single row its own copies; equal rows share theirs."""
    one = j.filter("__tb_n = 1").withColumn("__tb_k", F.explode(F.sequence(F.lit(1), F.col("__tb_c").cast("int"))))
    many = j.filter("__tb_n > 1").dropDuplicates(["__tb_d", "__tb_s", "__tb_h"]).withColumn("__tb_k", F.explode(F.sequence(F.lit(1), F.col("__tb_c").cast("int"))))
    return one.unionByName(many).select(*docs.columns)
