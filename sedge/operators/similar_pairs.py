"""All pairs of similar vectors of a table: hashed buckets with exact scores, or every pair in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that meet in one task at most, each way, and rows that a bucket should hold.
CELL, BUCKET = 2_048, 64


def plan(n: int, over: float, miss: float) -> tuple[int, int]:
    """(bits of a code, number of tables): codes so long that BUCKET unrelated rows share one, tables so many that a pair at the threshold is in
    no common bucket with a chance of ``miss`` at most. Two vectors at an angle t have the same bit with a chance of 1 - t / pi."""
    bits = max(1, round(math.log2(max(2, n / BUCKET))))
    same = (1 - math.acos(min(1.0, max(-1.0, over))) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def vector_classes(corpus: DataFrame, id_col: str, vector_col: str, kind_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, kind, vector of the row of the smallest id of each distinct kind and vector; id, rep of every row that has a vector).

    Vectors that differ only in length are different here; null kinds are a kind of their own.
    """
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(kind_col).alias("kind"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    own = rows.groupBy("kind", "vector").agg(F.min("id").alias("rep"))
    members = rows.join(own.withColumnsRenamed({"kind": "k", "vector": "v"}), F.col("kind").eqNullSafe(F.col("k")) & (F.col("vector") == F.col("v"))).select("id", "rep")
    return own.select(F.col("rep").alias("id"), "kind", "vector"), members


def similar_pairs(rows: DataFrame, over: float, keep: Callable[[DataFrame], DataFrame], together: Callable[[Column, Column], Column] | None = None, miss: float | None = 0.01, seed: int = 11) -> DataFrame:
    """a, b, score of all pairs a < b whose cosine is over the threshold and whose kinds may go together.

    rows: id, kind, vector; ids are distinct, as vector_classes() makes them. Each of some tables of codes (the signs of random
    projections) deals the rows to buckets; those of a bucket meet in cells of CELL rows each way, so no bucket is held whole.
    Scores are exact, so no wrong pair is found; a pair is missed with a chance of ``miss`` at most (less above the threshold). miss None: one
    bucket of all rows, so no pair is missed and all are compared, in cells. together: of two kinds, null by default: any.
    Zero vectors are like nothing. keep cuts lineage in the shared folder.
    """
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "a long, b long, score double")
    bits, tables = (0, 1) if miss is None else plan(n, over, miss)
    planes = spark.sparkContext.broadcast(np.random.default_rng(seed).normal(size=(width, bits * tables)))  # dimensions times bits: no rows

    def coded(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()) if len(batch) else np.zeros((0, width))
            code = ((x @ planes.value > 0).reshape(len(x), tables, bits) @ weights) if bits else np.zeros((len(x), 1), np.int64)
            yield pd.DataFrame({"id": batch["id"], "codes": list(code)})

    codes = rows.select("id", "vector").mapInPandas(coded, "id long, codes array<long>").select("id", F.posexplode("codes").alias("slot", "code"))
    shared = keep(codes.groupBy("slot", "code").agg(F.count("*").alias("n")).where("n > 1").select("slot", "code", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")))
    dealt = codes.join(shared, ["slot", "code"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("slot", "code", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id")

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(cell["vector"].to_numpy())
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(size > 0, size, 1)
        ids, block = cell["id"].to_numpy(), cell["block"].to_numpy()
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        alone = cell["lo"].iloc[0] == cell["hi"].iloc[0]
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ x.T
            fine = (s > over) & (ids[at : at + 512, None] < ids)
            if not alone:
                fine &= block[at : at + 512, None] != block
            i, j = np.nonzero(fine)
            for out, part in zip(found, (ids[at + i], ids[j], s[i, j])):
                out.append(part)
        return pd.DataFrame({k: np.concatenate(v) for k, v in zip(("a", "b", "score"), found)})

    pairs = cells.join(rows.select("id", "vector"), "id").groupBy("slot", "code", "lo", "hi").applyInPandas(meet, "a long, b long, score double")
    pairs = pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
    if together is not None:
        kinds = rows.select("id", "kind")
        pairs = pairs.join(kinds.withColumnsRenamed({"id": "a", "kind": "_x"}), "a").join(kinds.withColumnsRenamed({"id": "b", "kind": "_y"}), "b").where(together(F.col("_x"), F.col("_y")))
    return pairs.select("a", "b", "score")
