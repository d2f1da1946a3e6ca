"""Retrieval metrics by query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.aggregates import order_statistics


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k of each query that is ranked or has gold; null without gold, 0 without hits.

    ranked: query_id, id, rank; the first of repeated ids counts. gold: query_id, id, relevance (over 0).
    """
    once = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("pos") <= k)
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = gold.withColumn("p", F.row_number().over(best)).groupBy("query_id").agg(
        F.count("*").alias("n_gold"), F.sum(F.when(F.col("p") <= k, gain / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("idcg"))
    found = once.join(gold, ["query_id", "id"]).groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("pos").alias("first"), F.sum(gain / F.log2(F.col("pos") + 1)).alias("dcg"))
    out = ranked.select("query_id").unionByName(gold.select("query_id")).distinct().join(ideal, "query_id", "left").join(found, "query_id", "left")
    has = F.col("n_gold") > 0
    return out.select(
        "query_id",
        F.when(has, F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall"),
        F.when(has, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def fact_coverage(answer: Column, facts: list[list[str]]) -> Column:
    """Share of the facts of which some alternative is in the answer; null without facts."""
    if not facts:
        return F.lit(None).cast("double")
    found = [reduce(lambda a, b: a | b, (answer.contains(alternative) for alternative in alternatives)) for alternatives in facts]
    return reduce(lambda a, b: a + b, (f.cast("int") for f in found)) / len(facts)


def citation_metrics(citations: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, validity, precision, coverage, mean_iou of each case with gold spans.

    citations: case_id, evidence, start, end, length (of the evidence; null: not retrieved). gold: case_id, evidence, start, end, each once.
    Spans meet by case and evidence, never by range alone. Union is the hull of two spans that overlap.
    """
    valid = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("length"))
    marked = citations.withColumns({"valid": F.coalesce(valid, F.lit(False)), "cited": F.monotonically_increasing_id()})
    g = gold.select("case_id", "evidence", F.col("start").alias("g0"), F.col("end").alias("g1"))
    met = marked.where("valid").join(g, ["case_id", "evidence"])
    over = F.least("end", "g1") - F.greatest("start", "g0")
    met = met.where(over > 0).withColumn("iou", over / (F.greatest("end", "g1") - F.least("start", "g0")))
    counts = marked.groupBy("case_id").agg(F.count("*").alias("cited"), F.count_if("valid").alias("valid"))
    hits = met.groupBy("case_id").agg(F.countDistinct("cited").alias("hits"))
    best = g.join(met.groupBy("case_id", "evidence", "g0", "g1").agg(F.max("iou").alias("iou")), ["case_id", "evidence", "g0", "g1"], "left")
    spans = best.groupBy("case_id").agg(F.count("*").alias("spans"), F.count("iou").alias("covered"), F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"))
    out = spans.join(counts, "case_id", "left").join(hits, "case_id", "left")
    zero = F.lit(0.0)
    return out.select("case_id", F.coalesce(F.col("valid") / F.col("cited"), zero).alias("validity"), F.coalesce(F.col("hits") / F.col("cited"), zero).alias("precision"), (F.col("covered") / F.col("spans")).alias("coverage"), "mean_iou")


def summary(cases: DataFrame) -> DataFrame:
    """One row over all cases (id, done, recall, facts, expected, abstained, ms, tokens); nulls are left out of means."""
    done, wanted, held = F.col("done"), F.col("expected"), F.col("abstained")
    n = F.count_if(done)
    own = {c: F.when(done, F.col(c)) for c in ("recall", "facts", "ms", "tokens")}
    right = F.when(done & ~held, F.when(wanted, 0).when(F.col("facts").isNull(), 1).otherwise((F.col("facts") == 1).cast("int")))
    rows = cases.withColumn("_ms", own["ms"])
    one = rows.agg(
        F.count("*").alias("total"), n.alias("completed"), F.round(1 - n / F.count("*"), 6).alias("error_rate"), F.round(F.avg(own["recall"]), 6).alias("recall"), F.round(F.count(own["recall"]) / n, 6).alias("recall_cover"),
        F.round(F.avg(own["facts"]), 6).alias("facts"), F.round(F.avg(F.when(done, (wanted == held).cast("int"))), 6).alias("abstain_accuracy"), F.round(F.avg(F.when(done & wanted, held.cast("int"))), 6).alias("tpr"),
        F.round(F.avg(F.when(done & ~wanted, held.cast("int"))), 6).alias("fpr"), F.round(F.avg(right), 6).alias("selective"),
        F.sum(own["tokens"]).alias("tokens"), F.round(F.count(own["tokens"]) / n, 6).alias("token_cover"))
    times = order_statistics(rows, [], "_ms", {"p50": 0.5, "p95": 0.95}).withColumn("_one", F.lit(1))
    return one.withColumn("_one", F.lit(1)).join(times, "_one", "left").drop("_one")


def gate(one: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """code, actual, expected of the rules (code, column, = or >=, expected) that the one row of a summary breaks; null breaks all."""
    listed = F.array(*(F.struct(F.lit(code).alias("code"), F.col(c).cast("double").alias("actual"), F.lit(want).alias("expected"), F.lit(op).alias("rule")) for code, c, op, want in rules))
    kept = F.when(F.col("rule") == "=", F.col("actual") == F.col("expected")).otherwise(F.col("actual") >= F.col("expected"))
    return one.select(F.inline(listed)).where(~F.coalesce(kept, F.lit(False))).drop("rule")
