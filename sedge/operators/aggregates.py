"""Aggregates over rows of any number; all combine before the shuffle."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.streaming.shared import kept


def distribution(rows: DataFrame, by: list[str], value: str, values: list[str]) -> DataFrame:
    """by and one count column for each of the given values."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(value) == v).alias(f"n_{v}") for v in values])


def order_statistics(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], descending: bool = False) -> DataFrame:
    """by and, for each name in shares, the first value with at least that share of the group's values up to it; nulls are left out.

    Exact, in memory that hangs on no group: equal values are counted together, the distinct ones are sorted by range, and a value's place is what lies in the
    parts before its own and, within its part, before it. The sorted counts are kept in the shared folder. A group without values has no row; by may be empty.
    """
    group = by or ["_all"]
    own = rows.where(F.col(value).isNotNull()).select(*(by or [F.lit(1).alias("_all")]), F.col(value).alias("_value"))
    order = F.desc("_value") if descending else F.asc("_value")
    counts = own.groupBy(*group, "_value").agg(F.count("*").alias("_n"))
    ranged = kept(counts.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))  # a row for each group and part
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(w).alias("_total"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
    within = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy(order))
    placed = ranged.withColumn("_within", within).join(parts, reduce(lambda x, y: x & y, same, F.col("_part") == F.col("_p")))
    last = F.col("_before") + F.col("_within")

    def at(p: float) -> Column:
        place = F.greatest(F.lit(1), F.ceil(F.col("_total").cast("decimal(18,0)") * F.lit(Decimal(str(p))))).cast("long")
        return F.max(F.when((last >= place) & (last - F.col("_n") < place), F.col("_value")))

    return placed.groupBy(*group).agg(*(at(p).alias(n) for n, p in shares.items())).drop("_all")


def deltas(rows: DataFrame, by: str, baseline, measures: list[str]) -> DataFrame:
    """Each row's measures minus those of the one baseline row; null where either is."""
    base = rows.where(F.col(by) == baseline).select(*[F.col(m).alias(f"base_{m}") for m in measures]).limit(1)
    return rows.join(F.broadcast(base), how="left").select(by, *[(F.col(m) - F.col(f"base_{m}")).alias(f"d_{m}") for m in measures])


def prefixes(word: Column) -> Column:
    """All prefixes of a word, itself included: the nodes of its path in a trie."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))
