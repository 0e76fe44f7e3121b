"""Threshold rule alerts.

All rules are counted in one aggregate pass (``count_if`` per rule), then the
one-row result is unpivoted to one row per rule; rules that matched no row
are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import in_list, threshold


@dataclass
class Rule:
    rule_id: str
    label: str
    column: str
    threshold: float | int | str
    operator: str = ">"
    severity: str | None = None
    # F8: optional IN-list condition on another column, ANDed with the threshold
    in_column: str | None = None
    in_values: list = field(default_factory=list)


# The default rules and which of them is a warning.
DEFAULT_RULES = [
    ("high-expense", "High Expense Alert", "expenses", 5000, ">"),
    ("negative-profit", "Negative Profit Warning", "profit", 0, "<"),
]
WARNING_RULE_IDS = {"negative-profit"}


def default_rules(expense_col: str | None, profit_col: str | None) -> list[Rule]:
    cols = {"expenses": expense_col, "profit": profit_col}
    return [Rule(i, lbl, cols[k], t, op) for i, lbl, k, t, op in DEFAULT_RULES if cols[k]]


def rule_alerts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, label, column, triggered_count, severity) for rules
    that match at least one row."""
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "rule_id string, label string, column string, triggered_count long, severity string")
    aggs = []
    for k, r in enumerate(rules):
        cond = threshold(r.column, r.operator, r.threshold)
        if r.in_column:
            cond = cond & in_list(r.in_column, r.in_values)
        aggs.append(F.count_if(cond).alias(f"n{k}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.label).alias("label"),
                        F.lit(r.column).alias("column"), F.col(f"n{k}").cast("long").alias("triggered_count"),
                        F.lit(r.severity or ("warning" if r.rule_id in WARNING_RULE_IDS else "info"))
                        .alias("severity"))
               for k, r in enumerate(rules)]
    return row.select(F.inline(F.array(*structs))).filter(F.col("triggered_count") > 0)
