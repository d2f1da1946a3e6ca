"""The running top k and the index against whole products in numpy."""

import numpy as np
import pandas as pd
import pytest
from sedge.operators import ranking, vector_index
from sedge.plans.queries import QUERIES

DDL = "vec_id long, embedding array<float>, score string, list int"


def frame(spark, x, ids=None):
    rows = [(int(i), None if v is None else [float(y) for y in v], "s", 1) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, DDL).repartition(3)


def best(x, q, k, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[q] @ u.T
    out = {}
    for row, own in zip(q, s):
        order = np.lexsort((ids, -np.round(own, 9)))[:k]
        out[int(ids[row])] = [int(ids[o]) for o in order]
    return out


def got(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_forty_thousand_queries_in_one_tile_emit_k_rows_each(monkeypatch):
    """A task hands on queries times k rows at most, though a block of rows is far smaller than k blocks."""
    r = np.random.default_rng(1)
    q = r.normal(size=(40_000, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    x = r.normal(size=(400, 8))
    running, batch = ranking.Running(len(q), 10), pd.DataFrame({"vec_id": np.arange(400), "embedding": list(x)})
    blocks = 0
    for part, s in ranking._products([batch], np.arange(len(q)), q, "vec_id", "embedding"):
        running.add(part["vec_id"].to_numpy(), s)
        blocks += 1
        assert running.held <= 2 * 10 * len(q) and s.size <= ranking.CELLS
    row, ids, score = running.best()
    assert blocks > 5 and len(row) == 400_000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(q[:50] @ u.T, axis=1)[:, :-11:-1]
    assert np.allclose(score.reshape(-1, 10)[:50], want)


def test_running_keeps_smaller_ids_of_ties():
    running = ranking.Running(1, 2)
    for ids in ([9, 8], [7, 1], [3, 2]):
        running.add(np.array(ids), np.ones((1, 2)))
    assert running.best()[1].tolist() == [1, 2]


@pytest.mark.parametrize("tile", [16 << 20, 2_000])
def test_exact_search_in_any_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(ranking, "TILE_BYTES", tile)
    x = np.random.default_rng(2).normal(size=(300, 6)).astype(np.float32).astype(float)
    ids = np.arange(300) * 3
    df = frame(spark, [*x, None], [*ids, 1000])
    q = list(range(0, 300, 7))
    hits = ranking.vector_search(df, df.where("vec_id % 21 = 0"), 5)
    assert got(hits) == best(x, q, 5, ids)
    summary = {r.query_id: (r.compared, r.mean, r.high) for r in ranking.similarity_summary(df, df.where("vec_id % 21 = 0")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(summary[i * 3][0] == 300 and np.allclose(summary[i * 3][1:], [(u[i] @ u.T).mean(), 1]) for i in q)


def test_index_with_all_probes_is_exact_and_probes_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 40)
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 3
    x = np.concatenate([centres[r.integers(0, 20, 700)] + r.normal(size=(700, 16)), np.tile(centres[0], (350, 1)) + r.normal(size=(350, 16)) * 0.2]).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    df = frame(spark, [*x, None], [*ids, 5000])
    index = vector_index.build_index(df)
    assert index.rows.count() == len(x) == sum(index.sizes.values()) and index.rows.select("id").distinct().count() == len(x)
    asked = df.where("vec_id % 5 = 0")
    want = best(x, list(range(0, len(x), 5)), 10, ids)
    assert got(vector_index.index_search(index, asked, 10, len(index.centroids))) == want
    p = vector_index.choose_probes(index, df, 10, 0.95)
    some = got(vector_index.index_search(index, asked, 10, p))
    recall = sum(len(set(some[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    made = vector_index.products(index, asked, p)
    print("probes", p, "of", len(index.centroids), "recall", recall, "products", made, "of", len(want) * len(x))
    assert recall >= 0.9 and made < len(want) * len(x)


def test_empty_corpus(spark):
    df = frame(spark, [None], [1])
    index = vector_index.build_index(df)
    assert vector_index.index_search(index, df, 10, vector_index.choose_probes(index, df, 10)).count() == 0
    assert ranking.vector_search(df, df, 3).count() == 0 and ranking.similarity_summary(df, df).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    exact = ranking.vector_search(e, e.where("vec_id % 50 = 0"), 10).where("score >= 0.3").select("query_id", "id")
    found = QUERIES["o2_index_search"](spark, path).select("query_id", "id")
    recall = exact.intersect(found).count() / exact.count()
    index = vector_index.build_index(e)
    p = vector_index.choose_probes(index, e, 10)
    made, scan = vector_index.products(index, e.where("vec_id % 50 = 0"), p), e.where("vec_id % 50 = 0").count() * e.count()
    print("recall", recall, "probes", p, "of", len(index.centroids), "products", made, "of", scan)
    assert recall >= 0.9 and found.subtract(exact).count() <= 0.1 * exact.count() and made < scan
