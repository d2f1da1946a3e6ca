"""Entities merged pair by pair in a fixed order, in rounds over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import graph

#: Rounds over all pairs before what is left is looked at by component, and pairs of a component that one task goes through.
ROUNDS, TASK_PAIRS = 3, 50_000


def merges_in_order(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, target: who is merged into whom, if the pairs (a, b) are gone through by the smaller id, then the larger.

    A pair whose ends are both still there merges the larger into the smaller; a pair with an end that was merged away is skipped.
    So chains do not collapse: of 1-2 and 2-3 only the first merges. An id is kept once all smaller ids that it has pairs with
    are merged away, and merged into the smallest kept one of them. Each round decides all ids that can be told, of the whole table at once;
    pairs of decided ids are dropped. A chain takes a round for every two ids, so after ROUNDS components of up to
    TASK_PAIRS pairs are finished in a task each, and rounds go on for larger ones. keep cuts lineage in the shared folder.
    Null ids and pairs of an id with itself are nothing; repeated and turned pairs are one.
    """
    every = keep(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, gone, rounds = every, [], 0
    while not left.isEmpty():
        if rounds == ROUNDS:
            parts = keep(left.join(graph.components(left, keep), F.col("a") == F.col("node")).select("a", "b", "component"))
            small = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= TASK_PAIRS).select("component")
            gone.append(keep(parts.join(small, "component", "left_semi").groupBy("component").applyInPandas(_one_by_one, "node long")))
            left = keep(parts.join(small, "component", "left_anti").select("a", "b"))
        else:
            kept_ids = left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti")
            now = keep(left.join(kept_ids, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct())
            gone.append(now)
            rest = left.join(kept_ids, F.col("a") == F.col("node"), "left_anti")
            for end in ("a", "b"):
                rest = rest.join(now, F.col(end) == F.col("node"), "left_anti")
            left = keep(rest)
        rounds += 1
    merged = every.select(F.col("b").alias("node")).limit(0)
    for part in gone:
        merged = merged.unionByName(part)
    merged = keep(merged)
    into = every.join(merged, F.col("b") == F.col("node"), "left_semi").join(merged, F.col("a") == F.col("node"), "left_anti")
    return into.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("target"))


def _one_by_one(pairs: pd.DataFrame) -> pd.DataFrame:
    gone = set()
    for a, b in pairs.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
        if a not in gone and b not in gone:
            gone.add(b)
    return pd.DataFrame({"node": sorted(gone)}, dtype="int64")


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """id, name, aliases, mentions, chunks, description of the entities that stay.

    entities: the same columns, aliases and chunks as arrays. Those merged into one add their names, aliases, mentions and chunks in the order
    of their ids, each alias and chunk once, at its first place; the longest description stays, of equal ones the first.
    """
    to = merges.select(F.col("node").alias("id"), "target")
    own = entities.join(to, "id", "left").withColumn("into", F.coalesce("target", "id"))
    said = F.when(F.col("target").isNull(), F.col("aliases")).otherwise(F.concat(F.array("name"), F.col("aliases")))

    def united(values, name: str) -> DataFrame:
        each = own.select("into", "id", F.posexplode(values).alias("at", "value"))
        first = each.groupBy("into", "value").agg(F.min(F.struct("id", "at")).alias("at"))
        return first.groupBy(F.col("into").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(name))

    length = F.length(F.coalesce("description", F.lit("")))
    rest = own.groupBy("into").agg(F.sum("mentions").alias("mentions"), F.max_by("description", F.struct(length, -F.col("id"))).alias("description"))
    names = own.where("target IS NULL").select("id", "name")
    out = names.join(rest.withColumnRenamed("into", "id"), "id")
    for values, name in ((said, "aliases"), (F.col("chunks"), "chunks")):
        kind = entities.schema[name].dataType.simpleString()
        out = out.join(united(values, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out.select("id", "name", "aliases", "mentions", "chunks", "description")


def rewritten_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """relations (a, b and other columns) between the entities that stay; those that would join one with itself go."""
    out = relations
    for end in ("a", "b"):
        to = merges.select(F.col("node").alias(end), F.col("target").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.where("a <> b").select(relations.columns)
