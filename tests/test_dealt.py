"""Tables dealt by a key: parts of a bounded number of rows, and nothing moved after that; slugs of titles."""

import random

import pytest
from sedge.operators import graph, ranking
from sedge.plans import evaluations, graphs, queries, registry, stores

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "PART_ROWS", 100)
    assert registry.dealt(spark.range(5000), "id").rdd.getNumPartitions() == 50


def test_security_moves_each_table_once(spark):
    assert shuffles(evaluations.e4_security_counters(spark, SF)) == 2


def test_lanes_move_lines_once(spark):
    assert shuffles(ranking.reciprocal_rank_fusion(queries._lanes(spark, SF), {"price": 0.6})) == 1
    assert shuffles(queries.r5_weighted_fusion(spark, SF)) == 1


def test_titles_are_no_file_names(spark, tmp_path):
    rows = [(3, "u", "<title>About v1.5</title>"), (0, "u", None), (6, "u", "<title>Notes.md</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = stores.s25_article_list(spark, str(tmp_path)).select("page_id", "slug").collect()
    assert [tuple(x) for x in got] == [(3, "about-v1-5"), (6, "notes-md"), (0, None)]


def test_passages_against_a_plain_loop(spark):
    r = random.Random(3)
    pick = lambda own: r.choice([*own, None] if r.random() < 0.1 else own)
    refs = [(pick(range(12)), pick(range(0, 16, 2)), pick(range(1, 16, 2)), pick([0.1, 0.5, 0.9, 1.7, -1.0])) for _ in range(300)]
    nodes = {k: (r.random(), r.choice([0, 1, 2])) for k in range(16) if r.random() < 0.7}
    weight = {}
    for _, a, b, w in refs:
        weight[a, b] = max(weight.get((a, b), -9), -9 if w is None else w)
    weight = {k: 1.0 if w == -9 else min(1.0, max(0.0, w)) for k, w in weight.items()}
    want = {}
    for p, n in {(p, n) for p, a, b, _ in refs for n in (a, b) if n in nodes}:
        want.setdefault(p, []).append((nodes[n][0] * (2 if nodes[n][1] == 0 else 1), nodes[n][1]))
    for p, a, b in {(p, a, b) for p, a, b, _ in refs if a in nodes and b in nodes}:
        want[p].append(((nodes[a][0] + nodes[b][0]) / 2 * weight[a, b], min(nodes[a][1], nodes[b][1])))
    selected = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, score double, hop int")
    df = spark.createDataFrame(refs, "passage long, a long, b long, weight double").repartition(3)
    got = {x.passage: (round(x.score, 9), x.hop) for x in graph.passage_scores(selected, df).collect()}
    assert got == {p: (round(sum(s for s, _ in own), 9), min(h for _, h in own)) for p, own in want.items()}


def test_passages_move_each_line_three_times(spark):
    """By part, by supplier and by passage."""
    selected = spark.range(10).selectExpr("id AS node", "0.5D AS score", "1 AS hop")
    assert shuffles(graph.passage_scores(selected, graphs._numbered(spark, SF))) == 3


def test_fusions_of_lanes_move_lines_once(spark):
    for q in ("o4_fusion_sort", "g37_reciprocal_rank_sum", "r4_reciprocal_rank_fusion", "u5_first_occurrence"):
        assert shuffles(queries.QUERIES[q](spark, SF)) == 1, q


@pytest.mark.parametrize("name", ["o4_fusion_sort", "g37_reciprocal_rank_sum", "r4_reciprocal_rank_fusion", "u5_first_occurrence"])
def test_fused_parts_follow_lines(spark, monkeypatch, name):
    """More lines make more parts, not larger ones, and the same rows."""
    whole = queries.QUERIES[name](spark, SF)
    monkeypatch.setattr(registry, "PART_ROWS", 100)
    parts = queries.QUERIES[name](spark, SF)
    assert parts.rdd.getNumPartitions() == -(-registry.table(spark, SF, "lineitem").count() // 100) > whole.rdd.getNumPartitions()
    assert sorted(parts.collect()) == sorted(whole.collect())
