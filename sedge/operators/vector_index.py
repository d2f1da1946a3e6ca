"""An index of vectors as a table of lists, searched by probing the lists nearest to a query.

Lists are the cells of centroids that are fitted on a bounded sample; every row of the corpus is in one. A search
looks into the lists whose centroids are nearest to the query and scores their rows exactly. Lists and the queries that probe
them meet in blocks of bounded size, so a list or a query set may hold any share of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import ranking
from sedge.streaming.shared import written

#: Rows that centroids are fitted on at most, and most lists.
SAMPLE, MOST_LISTS = 65_536, 4_096
#: Rows of a list, and queries, that meet in one task at most (as hashes of ids deal them).
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 8_192


@dataclass(frozen=True)
class VectorIndex:
    """rows: list, id, vector (unit length), kept in the shared folder; sizes: rows of each list."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors; a centroid that no vector is nearest to moves to the vector farthest from its own."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        best, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4_096):
            s = x[at : at + 4_096] @ c.T
            best[at : at + 4_096] = s.argmax(axis=1)
            near[at : at + 4_096] = s.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=len(c)) == 0)
        total[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def _unit(batch: pd.DataFrame) -> np.ndarray:
    return ranking._unit_rows(batch, "vector")


def _nearest(c: np.ndarray, x: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centroids of each row, nearest first; of equal ones the first."""
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]


def build_index(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    """Fits centroids on about half of ``sample`` rows at most (those of certain hashes of the id) and puts every row into a list.

    lists: about the square root of the number of rows, up to MOST_LISTS. Rows without a vector are left out; an
    empty corpus has an empty index. The centroids (lists times dimensions) are sent with the tasks.
    """
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    n = rows.count()
    every = max(1, -(-2 * n // sample) if n > sample else 1)
    x = np.array(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(sample).toArrow()["vector"].to_pylist(), float)
    x = x.reshape(len(x), -1 if len(x) else 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = min(len(x), MOST_LISTS, lists or max(1, round(math.sqrt(n))))
    centroids = fit_centroids(x, k) if k else np.zeros((0, 0))
    sent = corpus.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            for at in range(0, len(batch), 4_096):
                part = batch.iloc[at : at + 4_096]
                v = _unit(part)
                yield pd.DataFrame({"list": _nearest(sent.value, v, 1)[:, 0].astype(np.int32) if len(part) else [], "id": part["id"], "vector": list(v)})

    kept = written(rows.mapInPandas(assign, "list int, id long, vector array<double>"), "index")
    sizes = {r["list"]: r["count"] for r in kept.groupBy("list").count().collect()}
    return VectorIndex(kept, centroids, sizes)


def _probes(index: VectorIndex, queries: DataFrame, probes: int, id_col: str, vector_col: str) -> DataFrame:
    """query_id, list, place, vector: a row for each list that a query looks into, nearest first from place 1."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches):
        for batch in batches:
            step = max(1, BLOCK_QUERIES // max(1, probes))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                v = _unit(part)
                near = _nearest(sent.value, v, probes)
                yield pd.DataFrame({"query_id": np.repeat(part["id"].to_numpy(), near.shape[1]), "list": near.ravel().astype(np.int32), "place": np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(part)), "vector": [x for x in v for _ in range(near.shape[1])]})

    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    return asked.mapInPandas(run, "query_id long, list int, place int, vector array<double>")


def index_search(index: VectorIndex, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k best rows, by exact cosine, of the ``probes`` lists nearest to each query.

    With as many probes as lists this is the exact search. Of equal scores smaller ids come first. Queries without a vector have no hits.
    """
    spark, empty = queries.sparkSession, "query_id long, id long, score double, rank int"
    if not len(index.centroids):
        return spark.createDataFrame([], empty)
    asked = _probes(index, queries, probes, id_col, vector_col)
    count = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list
    # how lists and their queries are cut: as many rows as lists
    plan = [(x, -(-index.sizes[x] // BLOCK_ROWS), -(-count[x] // BLOCK_QUERIES)) for x in sorted(index.sizes) if x in count]
    cuts = F.broadcast(spark.createDataFrame(plan, "list int, blocks int, chunks int"))

    def dealt(rows: DataFrame, own: str, by: str, over: str) -> DataFrame:
        """Rows dealt to one of their list's parts of one kind, once for each of its parts of the other kind."""
        other = "chunk" if own == "block" else "block"
        return rows.join(cuts, "list").select("list", by, "vector", F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(over) - 1)).alias(other))

    corpus, asked = dealt(index.rows, "block", "id", "chunks"), dealt(asked, "chunk", "query_id", "blocks")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = ranking.Running(len(asked), k)
        if len(rows) and len(asked):
            q, ids = np.stack(asked["vector"].to_numpy()), rows["id"].to_numpy()
            step = max(1, ranking.CELLS // len(q))
            for at in range(0, len(rows), step):
                best.add(ids[at : at + step], q @ np.stack(rows["vector"].to_numpy()[at : at + step]).T)
        row, ids, score = best.best()
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "id": ids, "score": score})

    keys = ["list", "block", "chunk"]
    hits = corpus.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score double")
    return ranking.top(hits, ["query_id"], "score", "id", k)


def products(index: VectorIndex, queries: DataFrame, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """Products that a search makes: of queries and centroids, and of queries and the rows of the lists they look into."""
    asked = {r["list"]: r["count"] for r in _probes(index, queries, probes, id_col, vector_col).groupBy("list").count().collect()}
    return sum(n * index.sizes.get(x, 0) for x, n in asked.items()) + sum(asked.values()) * len(index.centroids) // max(1, probes)


def choose_probes(index: VectorIndex, corpus: DataFrame, k: int, recall: float = 0.95, asked: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The fewest probes that find this share of the true k best of about ``asked`` rows of the corpus, which are searched exactly."""
    n = sum(index.sizes.values())
    if not n:
        return 1
    # other rows than those whose ids are divisible by round numbers, which are often a query set
    some = corpus.where(F.pmod(F.xxhash64(F.lit("probes"), F.col(id_col)), F.lit(max(1, n // asked))) == 0)
    hits = ranking.vector_search(corpus, some, k, None, id_col, vector_col).select("query_id", "id")
    order = _probes(index, some, len(index.centroids), id_col, vector_col).select("query_id", "list", "place")
    found = hits.join(index.rows.select("id", "list"), "id").join(order, ["query_id", "list"])
    place = {r["place"]: r["count"] for r in found.groupBy("place").count().collect()}
    whole, got = sum(place.values()), 0
    for p in sorted(place):
        got += place[p]
        if got >= recall * whole:
            return int(p)
    return len(index.centroids)
