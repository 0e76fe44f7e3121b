"""Answers to many routed questions at a time.

Thousands of questions ask few different things: an operation is one of the
actions over one column of a dataset and one metric, and a dataset has at most
200 columns.  The questions are reduced to their distinct operations, the
operations to the distinct pairs (column, metric), and all pairs of a dataset
are grouped in passes of PASS pairs each; sums, counts and extremes of a group
answer every aggregate of the pair.  Questions are joined to the answers last,
so no plan grows with their number and nothing is computed twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import floor_double, js_round
from ..operators import dashboard as DB
from ..session import written

#: pairs of column and metric grouped in one pass over a dataset
PASS = 32
MOST = 20
_PERIODS = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}
_OPERATION = ["dataset_id", "action", "metric", "x", "every", "aggregation", "direction"]


@dataclass
class Answers:
    """``questions``: question_id and what it was routed to, with answer_id;
    ``rows``: answer_id, position, key, value, change_pct, n.  Many questions
    share an answer."""
    questions: DataFrame
    rows: DataFrame

    def joined(self) -> DataFrame:
        """The rows of every question, top lists cut to the number asked for."""
        q = self.questions.select("dataset_id", "question_id", "action", "limit", "answer_id")
        j = q.join(self.rows, "answer_id").filter(F.col("limit").isNull() | (F.col("position") <= F.col("limit")))
        return j.select("dataset_id", "question_id", "action", "position", "key", "value", "change_pct", "n")


def _operations(routed: DataFrame) -> DataFrame:
    """Questions with their operation: what is grouped, by what, and how."""
    compares, tops = F.col("action") == "compare_periods", F.col("action") == "top_n"
    every = F.coalesce(F.create_map(*[F.lit(x) for kv in _PERIODS.items() for x in kv])[F.col("period_type")], F.lit("month"))
    limit = F.when(tops, F.least(F.greatest(F.coalesce(F.nullif(F.col("limit"), F.lit(0)), F.lit(5)), F.lit(1)), F.lit(MOST)))
    agg = F.when(F.col("aggregation").isin("avg", "min", "max", "count"), F.col("aggregation")).otherwise(F.lit("sum"))
    return routed.select("dataset_id", "question_id", "action", "metric", F.when(compares, F.col("date_column")).otherwise(F.col("group_by")).alias("x"),
                         F.when(compares, every).alias("every"), F.when(compares | tops, F.lit("sum")).otherwise(agg).alias("aggregation"),
                         F.when(tops, F.when(F.col("direction") == "asc", F.lit("asc")).otherwise(F.lit("desc"))).alias("direction"), limit.alias("limit"))


def _pair_groups(pairs: list, load: Callable[[str], DataFrame]) -> DataFrame | None:
    """(pair, key, n, c, s, lo, hi) for every pair; ``pairs`` are rows (pair, dataset_id, x, metric, every)."""
    out, by_dataset = None, {}
    for p in pairs:
        by_dataset.setdefault(p.dataset_id, []).append(p)
    for dataset, mine in by_dataset.items():
        df = load(dataset)
        for at in range(0, len(mine), PASS):
            some = mine[at:at + PASS]
            charts = [DB.Chart(str(p.pair), "", "bar", p.x, p.metric or DB.ROWS, "sum", every=p.every) for p in some]
            g = DB.grouped_cells(df, [], charts)
            ids = F.array(*[F.lit(p.pair) for p in some])
            g = written(g.select(F.get(ids, F.col("item")).alias("pair"), "key", "n", "c", "s", "lo", "hi"), "answer-groups")
            out = g if out is None else out.unionByName(g)
    return out


def answer(routed: DataFrame, load: Callable[[str], DataFrame]) -> Answers:
    """Answers to routed questions (the output of R20); ``load`` gives a dataset's rows.

    group_by: every group (null is 'Unknown'), its aggregate of numbers to 2 digits
    or, without a number, its number of rows.  top_n: the first groups by
    their sum, at most MOST, with positions, ties by key.  compare_periods: sums per
    period with positions in order of time and the whole percentage of change to
    the previous present one.  A question whose dataset has no column of the kind
    it needs has no rows."""
    spark = routed.sparkSession
    q = _operations(routed)
    ops = q.filter("x is not null").select(*_OPERATION).distinct()
    ops = written(ops.withColumn("answer_id", F.monotonically_increasing_id()), "answer-operations")
    pair_of = ["dataset_id", "x", "metric", "every"]
    pairs = written(ops.select(*pair_of).distinct().withColumn("pair", F.monotonically_increasing_id()), "answer-pairs")
    groups = _pair_groups(pairs.orderBy("pair").collect(), load)  # bounded by the columns of the datasets asked about
    if groups is None:
        groups = spark.createDataFrame([], "pair long, key string, n long, c long, s double, lo double, hi double")
    on = (ops["dataset_id"] == pairs["dataset_id"]) & (ops["x"] == pairs["x"]) & ops["metric"].eqNullSafe(pairs["metric"]) & ops["every"].eqNullSafe(pairs["every"])
    asked = ops.join(pairs, on).select("answer_id", "action", "aggregation", "direction", "pair", ops["metric"])
    j = asked.join(groups, "pair").withColumn("key", F.coalesce("key", F.lit("Unknown")))
    total, rows = F.coalesce("s", F.lit(0.0)), F.col("n").cast("double")
    agg = F.col("aggregation")
    value = (F.when(agg == "count", rows).when(F.col("metric").isNull() | (F.col("c") == 0), rows).when(agg == "avg", F.col("s") / F.col("c"))
             .when(agg == "min", F.col("lo")).when(agg == "max", F.col("hi")).otherwise(F.col("s")))
    plain = j.filter("action = 'group_by'").select("answer_id", F.lit(None).cast("int").alias("position"), "key", js_round(value, 2).alias("value"),
                                                   F.lit(None).cast("double").alias("change_pct"), "n")
    summed = js_round(F.when(F.col("metric").isNull(), rows).otherwise(total), 2)
    t = j.filter("action = 'top_n'").select("answer_id", "direction", "key", summed.alias("value"), "n")
    signed = F.when(F.col("direction") == "asc", F.col("value")).otherwise(-F.col("value"))
    t = t.withColumn("position", F.row_number().over(Window.partitionBy("answer_id").orderBy(signed, "key"))).filter(F.col("position") <= MOST)
    t = t.select("answer_id", "position", "key", "value", F.lit(None).cast("double").alias("change_pct"), "n")
    # periods are few
    w = Window.partitionBy("answer_id").orderBy("key")
    c = j.filter("action = 'compare_periods'").select("answer_id", "key", F.when(F.col("metric").isNull(), rows).otherwise(total).alias("raw"), "n")
    prev, shown = F.lag("raw").over(w), js_round("raw", 2)
    change = F.when(prev > 0, floor_double((shown - prev) / prev * F.lit(100.0) + F.lit(0.5))).otherwise(F.lit(0.0))
    c = c.select("answer_id", F.row_number().over(w).alias("position"), "key", shown.alias("value"), change.alias("change_pct"), "n")
    same = F.lit(True)
    for k in _OPERATION:
        same = same & q[k].eqNullSafe(ops[k])
    questions = q.join(ops, same, "left").select(*[q[k] for k in q.columns], "answer_id")
    return Answers(questions, written(plain.unionByName(t).unionByName(c), "answers"))
