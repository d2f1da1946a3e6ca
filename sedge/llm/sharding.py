"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Everything here is DataFrame functions. Rows are numbered in key order, the number is
sent through a keyed permutation of 0..n-1, and the permuted place gives shard
and slot by division. Anyone who knows n, the seed and a row number can
compute its place, and the place of any row can be found again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed

ROUNDS = 6
#: Walks tried in one expression. A walk leaves 0..n-1 with a chance under n ** -0.5, so more than this is not seen; it would raise.
WALKS = 64
_IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, *keys: Column) -> tuple[DataFrame, int]:
    """rows with _row, their number from 0 in the order of keys, and how many there are.

    One range exchange of the rows given (not of texts, if they are left out). Rows
    with equal keys are told apart by their place in the input, so a
    key that fills a third of the table is split over partitions.
    """
    order = [*keys, F.col("_place")]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
    kept = checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition: bounded by the number of partitions, not by rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = kept.join(F.broadcast(bases), "_part").withColumn("_row", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
    return out, kept.count()


def whole_part(x: Column, by: int) -> Column:
    """x div by, in whole numbers."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``row`` in a permutation of 0..n-1.

    A Feistel network over a rectangle of width * height >= n numbers alternately
    adds a keyed hash of one coordinate to the other; a result of n or more walks on along
    its cycle until it is below n.
    """
    if n < 1:
        return row
    width = math.isqrt(n - 1) + 1
    height = -(-n // width)

    def network(x: Column) -> Column:
        left, right = whole_part(x, width), F.pmod(x, F.lit(width))
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), left), F.lit(width)), F.lit(width))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), right), F.lit(height)), F.lit(height))
        return left * width + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"), lambda got, k: F.when((got >= 0) & (got < n), got).otherwise(network(F.when(k == 1, row).otherwise(got))))


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Deal rows to ``shards`` by a keyed permutation; returns doc_id, the carried columns, shard and slot.

    Shards differ by one row at most and slots run from 0 without gaps. The order is by
    doc_id, then the carried columns, so equal inputs give equal places whatever their
    files. Null ids come first. Rows that are equal in all of these get places of their own. Texts of any length cost what their carried
    columns do. An empty table gives an empty result. Columns not carried are ignored, whatever their names.
    """
    carry = carry or {}
    thin = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in carry.items()))
    rows, n = numbered(thin, F.col("doc_id"), *map(F.col, carry))
    placed = rows.withColumn("_place", permuted(F.col("_row"), n, seed))
    fine = F.when((F.col("_place") < 0) | (F.col("_place") >= n), F.raise_error(F.lit("a permutation cycle is too long; choose another seed"))).otherwise(F.pmod("_place", F.lit(shards)))
    return placed.select("doc_id", *carry, fine.cast("int").alias("shard"), whole_part(F.col("_place"), shards).alias("slot"))
