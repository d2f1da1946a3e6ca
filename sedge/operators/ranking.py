"""Ranked lists: search, fusion, caps and merges. Ties always end in an id, so results do not hang on partitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.text import lexical_tokens
from sedge.streaming.shared import written

#: Bytes of query vectors in a broadcast tile; products of queries and rows that are held at once (8 bytes each).
TILE_BYTES, CELLS = 16 << 20, 1 << 21


def top(hits: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group with their 1-based rank; Spark keeps only k a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tiles(queries: DataFrame, id_col: str, vector_col: str):
    """Broadcast (ids, unit vectors) of the queries, TILE_BYTES each: the driver holds one tile at a time."""
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    tiles = -(-n * 8 * (width or 1) // TILE_BYTES)
    for t in range(tiles):
        own = (rows if tiles == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(tiles)) == t)).toArrow()
        if len(own):
            q = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            yield queries.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), q))


def _per_tile(corpus: DataFrame, queries: DataFrame, id_col: str, vector_col: str, search, ddl: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows that search(tile) makes of the corpus, for all tiles of queries; the corpus is read once for each tile."""
    rows = corpus.select(id_col, *keep, vector_col).where(F.col(vector_col).isNotNull())
    parts = [rows.mapInPandas(search(tile), ddl) for tile in _tiles(queries, id_col, vector_col)]
    return reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], ddl)


def _unit_rows(batch: pd.DataFrame, vector_col: str) -> np.ndarray:
    x = np.stack(batch[vector_col].to_numpy()).astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _products(batches, names: np.ndarray, q: np.ndarray, id_col: str, vector_col: str):
    """(rows, products with all queries) of blocks of the batches, CELLS products each."""
    step = max(1, CELLS // max(1, len(names)))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            yield part, q @ _unit_rows(part, vector_col).T


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, all of those equal to the last one with them; flat row numbers and columns."""
    if s.shape[1] <= k:
        return np.nonzero(np.ones(s.shape, bool))
    last = np.partition(s, -k, axis=1)[:, -k, None]
    return np.nonzero(s >= last)


class Running:
    """The k best of each query over all blocks of a task; of equal scores the smaller ids. Holds some 2 k rows a query."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.rows, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, ids: np.ndarray, s: np.ndarray, threshold: float | None = None) -> None:
        """A block of products: a row for each query, a column for each id."""
        row, column = _best(s, self.k)
        score = s[row, column]
        keep = score >= (self.least[row] if threshold is None else np.maximum(self.least[row], threshold))
        self.take(row[keep], ids[column[keep]], score[keep])

    def take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.rows.append((row, ids, score))
        self.held += len(row)
        if self.held > 2 * self.k * len(self.least):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        full = place == self.k - 1
        self.least[row[full]] = score[full]
        self.rows, self.held = [(row[keep], ids[keep], score[keep])], int(keep.sum())
        return self.rows[0]


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: exact cosine top k of each query; the threshold holds before the limit.

    The queries go out in tiles of TILE_BYTES; the corpus is read once for each tile. Products are made CELLS at a time. A task keeps
    the k best of each query over all its rows and hands on those at its end, so it emits queries times k rows
    at most. Rows without a vector are left out.
    """

    def search(tile):
        def run(batches):
            names, q = tile.value
            best = Running(len(names), k)
            for part, s in _products(batches, names, q, id_col, vector_col):
                best.add(part[id_col].to_numpy(), s, threshold)
            row, ids, score = best.best()
            yield pd.DataFrame({"query_id": names[row], "id": ids, "score": score})

        return run

    return top(_per_tile(corpus, queries, id_col, vector_col, search, "query_id long, id long, score double"), ["query_id"], "score", "id", k)


def similarity_summary(corpus: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, compared, mean, high: how each query's cosines with all rows are spread; a task hands on one row a query."""

    def search(tile):
        def run(batches):
            names, q = tile.value
            n, total, high = 0, np.zeros(len(names)), np.full(len(names), -np.inf)
            for _, s in _products(batches, names, q, id_col, vector_col):
                n, total, high = n + s.shape[1], total + s.sum(axis=1), np.maximum(high, s.max(axis=1))
            if n:
                yield pd.DataFrame({"query_id": names, "n": n, "total": total, "high": high})

        return run

    parts = _per_tile(corpus, queries, id_col, vector_col, search, "query_id long, n long, total double, high double")
    return parts.groupBy("query_id").agg(F.sum("n").alias("compared"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("high"))


def nearest_center(rows: DataFrame, centers: DataFrame, id_col: str, vector_col: str, center_id: str, center_col: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The id and kept columns of each row, center (the id of the center of the highest cosine, of equal ones the smallest) and s.

    Any number of centers: they go out in tiles, and of a row's best ones in all tiles the best counts. A row's products are summed in its task. Rows without a vector are left out.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def search(tile):
        def run(batches):
            names, q = tile.value
            order = np.argsort(names, kind="stable")
            for part, s in _products(batches, names[order], q[order], id_col, vector_col):
                best = s.argmax(axis=0)
                yield pd.DataFrame({**{c: part[c] for c in (id_col, *keep)}, "center": names[order][best], "s": s[best, np.arange(len(part))]})

        return run

    tiles = list(_tiles(centers, center_id, center_col))
    own = rows.select(id_col, *keep, vector_col).where(F.col(vector_col).isNotNull())
    parts = [own.mapInPandas(search(tile), f"{kinds}, center long, s double") for tile in tiles]
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{kinds}, center long, s double")
    if len(parts) == 1:
        return parts[0]
    best = F.max(F.struct("s", (-F.col("center")).alias("c"))).alias("b")
    return reduce(DataFrame.unionByName, parts).groupBy(id_col, *keep).agg(best).select(id_col, *keep, (-F.col("b.c")).alias("center"), F.col("b.s").alias("s"))


def similar_rows(corpus: DataFrame, queries: DataFrame, over: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score of every row whose cosine with a query of the stated set is over the threshold; nothing is shuffled."""

    def search(tile):
        def run(batches):
            names, q = tile.value
            for part, s in _products(batches, names, q, id_col, vector_col):
                row, column = np.nonzero(s > over)
                yield pd.DataFrame({"query_id": names[row], "id": part[id_col].to_numpy()[column], "score": s[row, column]})

        return run

    return _per_tile(corpus, queries, id_col, vector_col, search, "query_id long, id long, score double")


def grouped_vector_search(corpus: DataFrame, queries: DataFrame, group_col: str, groups: int, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, the group, id, score, grp, place: the best groups of each query by their best hit, and the best hits of each.

    A task keeps the best hits of each query and group over a batch; groups are told apart as long numbers.
    """

    def search(tile):
        def run(batches):
            names, q = tile.value
            for batch in batches:
                for label, rows in batch.groupby(group_col, sort=True):
                    best = Running(len(names), size)
                    for part, s in _products([rows], names, q, id_col, vector_col):
                        best.add(part[id_col].to_numpy(), s)
                    row, ids, score = best.best()
                    yield pd.DataFrame({"query_id": names[row], group_col: label, "id": ids, "score": score})

        return run

    hits = _per_tile(corpus, queries, id_col, vector_col, search, f"query_id long, {group_col} long, id long, score double", [group_col])
    best = top(hits, ["query_id", group_col], "score", "id", size).withColumnRenamed("rank", "place")
    leaders = top(best.where("place = 1").select("query_id", group_col, "score"), ["query_id"], "score", group_col, groups)
    return best.join(leaders.select("query_id", group_col, F.col("rank").alias("grp")), ["query_id", group_col])


#: Distinct query tokens up to which they are sent to the tasks as a list; more are met by a join.
ASKED_WORDS = 50_000


def bm25_search(docs: DataFrame, queries: DataFrame, k: int | None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank (k None: all hits, without rank). docs: doc_id, text; queries: query_id, text. Repeated query tokens count each time.

    The texts are read and cut once: what is kept in the shared folder is a document's length and those of its tokens that some query has.
    The number of documents, their mean length, document frequencies and scores all come from that. Up to ASKED_WORDS
    distinct query tokens are sent to the tasks, more are met by a join.
    """
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    words = asked.select("token").distinct()
    few = words.limit(ASKED_WORDS + 1).toArrow()["token"].to_pylist()
    cut = docs.select("doc_id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).select("doc_id", F.size("tokens").alias("len"), "tokens")
    if len(few) <= ASKED_WORDS:
        cut = cut.withColumn("tokens", F.filter("tokens", lambda t: t.isin(few) if few else F.lit(False)))
    own = written(cut, "postings")
    whole = own.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
    postings = own.select("doc_id", "len", F.explode("tokens").alias("token")).groupBy("doc_id", "len", "token").agg(F.count("*").alias("tf"))
    if len(few) > ASKED_WORDS:
        postings = postings.join(words, "token", "left_semi")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(whole["avgdl"] or 1.0)))
    hits = asked.join(postings.join(df, "token"), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * weight).alias("score")).where("score > 0")
    return hits if k is None else top(hits, ["query_id"], "score", "doc_id", k)


def bm25_within(hits: DataFrame, docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, score of each hit that has a token of its query, where only a query's own hits are its corpus.

    hits: query_id, id (bounded by a search's k); docs: id, text; queries: query_id, text.
    """
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    own = hits.join(docs.select("id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), "id").select("query_id", "id", F.size("tokens").alias("len"), "tokens")
    w = Window.partitionBy("query_id")
    own = own.withColumns({"n": F.count("*").over(w), "avgdl": F.avg("len").over(w)})
    postings = own.select("query_id", "id", "len", "n", "avgdl", F.explode("tokens").alias("token")).groupBy("query_id", "id", "len", "n", "avgdl", "token").agg(F.count("*").alias("tf"))
    met = postings.join(asked, ["query_id", "token"]).withColumn("df", F.count("*").over(Window.partitionBy("query_id", "token")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return met.groupBy("query_id", "id").agg(F.sum(score).alias("score"))


def reciprocal_rank_fusion(hits: DataFrame, weights: dict[str, float], constant: int = 60) -> DataFrame:
    """query_id, id, score: the sum of weight / (constant + rank) over lanes. hits: query_id, lane, id, rank. Lanes of weight 0 add nothing, not even ids."""
    w = reduce(lambda c, kv: c.when(F.col("lane") == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(0.0)))
    return hits.withColumn("w", F.coalesce(w, F.lit(1.0))).where("w > 0").groupBy("query_id", "id").agg(F.sum(F.col("w") / (constant + F.col("rank"))).alias("score"))


def fusion_conflicts(hits: DataFrame, identity: list[str]) -> DataFrame:
    """query_id, id, variants of the candidates that lanes know with different content or provenance (the columns of ``identity``; null is a value).

    Fusing these would mix two things under one id: the caller stops, or leaves them out by an anti-join.
    """
    same = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in identity))
    return hits.groupBy("query_id", "id").agg(F.countDistinct(same).alias("variants")).where("variants > 1")


def score_fusion(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, id, score: the weighted sum of lanes' min-max scores; a lane whose scores are all equal counts 1."""
    own = Window.partitionBy("query_id", "lane")
    lanes = hits.select("query_id", "id", "lane", "score", F.min("score").over(own).alias("lo"), F.max("score").over(own).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    w = reduce(lambda c, kv: c.when(F.col("lane") == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(0.0)))
    return lanes.groupBy("query_id", "id").agg(F.sum(F.coalesce(w, F.lit(0.0)) * scaled).alias("score"))


def source_cap(rows: DataFrame, source: str, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each source in the given order; rows without one share a source."""
    w = Window.partitionBy(F.coalesce(source, F.lit(""))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def max_merge(lists: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """Union of lists; an id in several keeps its highest score."""
    return reduce(DataFrame.unionByName, lists).groupBy(*key).agg(F.max(score).alias(score))


def mmr(hits: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """query_id, id, position: greedy maximal marginal relevance over each query's list (bounded by its search's k).

    hits: query_id, id, score, rank, embedding. Similarity to what is chosen starts at 0; of equal values the first in rank order wins. Rows without
    an embedding follow in rank order while there is room.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        has = group.embedding.notna().to_numpy()
        ids, rest = group.id.to_numpy()[has], group.id.to_numpy()[~has]
        out = []
        if len(ids):
            x = np.stack(group.embedding.to_numpy()[has]).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            relevance, near, left = group.score.to_numpy()[has], np.zeros(len(ids)), np.ones(len(ids), bool)
            for _ in range(min(k, len(ids))):
                at = int(np.where(left, balance * relevance - (1 - balance) * near, -np.inf).argmax())
                out.append(ids[at])
                left[at] = False
                near = np.maximum(near, x @ x[at])
        out = [*out, *rest][:k]
        return pd.DataFrame({"query_id": group.query_id.iloc[0], "id": out, "position": np.arange(1, len(out) + 1)})

    return hits.groupBy("query_id").applyInPandas(choose, "query_id long, id long, position long")
