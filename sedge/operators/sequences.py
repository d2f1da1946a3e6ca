"""Operators over ordered rows: runs, budgets, windows of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], order: list[str], value: str, *aggs: Column) -> DataFrame:
    """One row for each run of equal values: by, value, run (from 1), length and aggs."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    numbered = rows.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run", value).agg(F.count("*").alias("length"), *aggs)


def prefix_within(rows: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows up to, not with, the first that takes the running cost over the budget; used has the running cost."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def message_window(messages: DataFrame, rounds: int) -> DataFrame:
    """System messages and the last 2 * rounds others of each conversation; of equal turns the later text is the later message."""
    w = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"), F.desc("text"))
    return messages.withColumn("_n", F.row_number().over(w)).where((F.col("role") == "system") | (F.col("_n") <= 2 * rounds)).drop("_n")


def running_totals(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{c}_so_far": F.sum(c).over(w) for c in columns})
