"""Similar pairs against all products in numpy."""

import numpy as np
import pytest
from sedge.operators import similar_pairs
from sedge.plans.queries import QUERIES
from sedge.streaming.shared import kept


def planted(n=900, d=24, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(0, n, 3):  # near copies, at all distances
        x[i + 1] = x[i] + r.normal(size=d) * r.uniform(0, 1.2)
    x[30:60] = x[30] + r.normal(size=(30, d)) * 0.05
    return x


def brute(x, over, kinds=None):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    return {(i, j): s[i, j] for i, j in zip(*np.nonzero(s > over)) if i < j and (kinds is None or kinds[i] == kinds[j] or 0 in (kinds[i], kinds[j]))}


def rows(spark, x, kinds):
    return spark.createDataFrame([(i, int(k), [float(y) for y in v]) for i, (v, k) in enumerate(zip(x, kinds))], "id long, kind int, vector array<double>").repartition(3)


@pytest.mark.parametrize("cell", [2_048, 20])
def test_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(similar_pairs, "CELL", cell)
    x = planted()
    kinds = np.random.default_rng(2).integers(0, 4, len(x))
    df = rows(spark, x, kinds)
    same = lambda a, b: (a == b) | (a == 0) | (b == 0)
    want = brute(x, 0.85, kinds)
    exact = {(r.a, r.b): r.score for r in similar_pairs.similar_pairs(df, 0.85, kept, same, miss=None).collect()}
    assert set(exact) == set(want) and all(abs(exact[k] - v) < 1e-9 for k, v in want.items()) and len(want) > 200
    some = {(r.a, r.b) for r in similar_pairs.similar_pairs(df, 0.85, kept, same).collect()}
    assert some <= set(want) and len(some) >= 0.98 * len(want)


def test_plan_of_tables():
    for n in (100, 10_000, 10**7):
        bits, tables = similar_pairs.plan(n, 0.85, 0.01)
        assert (1 - (1 - np.arccos(0.85) / np.pi) ** bits) ** tables <= 0.01
    assert similar_pairs.plan(1000, 1.0, 0.01)[1] == 1


def test_classes_and_nothing(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    reps, members = similar_pairs.vector_classes(df, "vec_id", "embedding", "label")
    assert {r.id for r in reps.collect()} == {3, 4, 7, 8} and {(r.id, r.rep) for r in members.collect()} == {(5, 3), (3, 3), (4, 4), (7, 7), (8, 8), (9, 8)}
    assert {(r.a, r.b) for r in similar_pairs.similar_pairs(reps, 0.85, kept).collect()} == {(3, 4), (3, 8), (4, 8)}
    assert similar_pairs.similar_pairs(reps.limit(0), 0.85, kept).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_whole_tables(spark, sf):
    """The stored vectors have few near neighbours, so the threshold is lower here; the query's own is 0.85."""
    path = f"/root/testdata/sf{sf}"
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    own = e.collect()
    x, ids, kinds = np.array([r.embedding for r in own], float), [r.vec_id for r in own], [r.label for r in own]
    reps, _ = similar_pairs.vector_classes(e, "vec_id", "embedding", "label")
    found = similar_pairs.similar_pairs(kept(reps), 0.4, kept, lambda a, b: (a == b) | (a == 0) | (b == 0))
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in brute(x, 0.4, kinds)}
    got = {(r.a, r.b) for r in found.collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 10
    far = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in brute(x, 0.85, kinds)}
    assert {(r.i, r.j) for r in QUERIES["j2_entity_self_join"](spark, path).collect()} == far
