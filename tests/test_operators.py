"""Operators against plain loops and on the edges that tables do not have."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sedge.functions import text as T
from sedge.functions import vectors as V
from sedge.operators import aggregates, context, evaluation, graph, ranking, sequences, tables
from sedge.plans.queries import QUERIES
from sedge.streaming import totals
from sedge.streaming.shared import kept

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_upsert_keeps_one_row_a_key(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "n")], "k int, v string")
    got = sorted(map(repr, tables.upsert(stored, new, ["k"], [F.desc("v")]).collect()))
    assert got == sorted(["Row(k=1, v='a')", "Row(k=2, v='y')", "Row(k=3, v='z')", "Row(k=None, v='n')"])
    manifest = tables.replace_manifest(stored, new, F.col("k") >= 2, ["k"])
    assert sorted((r.k or 0, r.v) for r in manifest.collect()) == [(0, "c"), (1, "a"), (2, "x"), (3, "z")]


def test_compare_and_set_applies_one_change(spark):
    stored = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "k int, version int, v string")
    changes = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 4, "z"), (2, 6, "late")], "k int, expected int, new string")
    assert sorted(map(tuple, tables.compare_and_set(stored, changes, ["k"], "version", "v").collect())) == [(1, 6, "x", True), (2, 7, "b", False)]


def test_plan_diff_of_null_and_repeated_rows(spark):
    planned = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, d string")
    stored = spark.createDataFrame([(1, "z"), (1, "a"), (2, None), (4, None)], "k int, d string")
    assert sorted(map(tuple, tables.plan_diff(planned, stored, ["k"], "d").collect())) == [(1, "complete"), (2, "conflicting"), (3, "missing"), (4, "complete")]


def test_filled_upsert_and_missing_only(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 3), (3, "c", None)], "k int, v string, n int")
    assert sorted(map(tuple, tables.filled_upsert(stored, new, ["k"]).collect())) == [(1, "a", None), (2, "b", 3), (3, "c", None)]
    assert sorted(map(tuple, tables.missing_only(stored, new, ["k"]).collect())) == [(1, "a", None), (2, "b", 2), (3, "c", None)]


def test_wrong_dimensions_fail(spark):
    with pytest.raises(Exception, match="dimension 2"):
        tables.checked_vectors(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 3).collect()


def test_metrics_of_a_query_without_hits(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "query_id string, id int, rank int")
    gold = spark.createDataFrame([("a", 2, 3), ("c", 5, 1)], "query_id string, id int, relevance int")
    got = {r.query_id: (r.recall, r.mrr) for r in evaluation.retrieval_metrics(ranked, gold, 3).collect()}
    assert got == {"a": (1.0, 0.5), "b": (None, None), "c": (0.0, 0.0)}


def test_hand_values_of_the_metrics(spark):
    gold = spark.createDataFrame([("q", "alpha", 3), ("q", "beta", 1)], "query_id string, id string, relevance int")
    ranked = spark.createDataFrame([("q", "beta", 1), ("q", "beta", 2), ("q", "alpha", 3)], "query_id string, id string, rank int")
    r = evaluation.retrieval_metrics(ranked, gold, 2).first()
    assert r.recall == 1 and abs(r.ndcg - (1 + 7 / np.log2(3)) / (7 + 1 / np.log2(3))) < 1e-12


def test_citations(spark):
    gold = spark.createDataFrame([(1, "e", 10, 20), (1, "e", 30, 40), (2, "e", 0, 5)], "case_id int, evidence string, start int, end int")
    cited = spark.createDataFrame([(1, "e", 15, 25, 100), (1, "e", 90, 120, 100), (1, "f", 0, 5, None)], "case_id int, evidence string, start int, end int, length int")
    got = {r.case_id: (r.validity, r.precision, r.coverage, r.mean_iou) for r in evaluation.citation_metrics(cited, gold).collect()}
    assert got[1] == (1 / 3, 1 / 3, 0.5, (5 / 15) / 2) and got[2] == (0.0, 0.0, 0.0, 0.0)


def test_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, v int").json(str(tmp_path / "in"))
    got = totals.totals(stream, ["k"], F.sum("v").alias("v"))
    assert got.columns == ["k", "v"] and got.count() == 0


def test_equal_turns_have_one_result(spark):
    rows = [("c", 1, "user", t) for t in "abcdefgh"] + [("c", 0, "system", "s")]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(parts)
        assert sorted(r.text for r in sequences.message_window(df, 1).collect()) == ["g", "h", "s"]


def plain_mmr(items, k, balance):
    """items: (id, score, vector or None) in rank order."""
    have, out = [x for x in items if x[2] is not None], []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in have}
    left = list(have)
    while left and len(out) < k:
        best = max(left, key=lambda x: (balance * x[1] - (1 - balance) * max([0.0, *(float(unit[x[0]] @ unit[o]) for o in out)]), -items.index(x)))
        out.append(best[0])
        left.remove(best)
    return [*out, *(i for i, _, v in items if v is None)][:k]


def test_mmr_against_a_plain_loop(spark):
    r = np.random.default_rng(3)
    rows = []
    for q in range(12):
        for rank in range(1, 15):
            v = None if r.random() < 0.2 else [float(x) for x in r.integers(-2, 3, 3)]
            rows.append((q, int(r.integers(0, 10**6)), float(round(r.random(), 1)), rank, v if v is None or any(v) else [1.0, 0.0, 0.0]))
    got = {}
    for x in ranking.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, rank int, embedding array<double>"), 6, 0.7).collect():
        got.setdefault(x.query_id, []).append((x.position, x.id))
    for q in range(12):
        assert [i for _, i in sorted(got[q])] == plain_mmr([(x[1], x[2], x[4]) for x in sorted(rows, key=lambda x: x[3]) if x[0] == q], 6, 0.7)


def test_capped_and_diverse(spark):
    got = QUERIES["r7_capped_and_diverse"](spark, SF).toPandas()
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    counts = got.assign(label=got.id.map(labels)).groupby(["query_id", "label"]).size()
    assert counts.max() <= 3 and (got.groupby("query_id").size() == 10).all()


def test_search_in_small_tiles_and_cells(spark, monkeypatch):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = ranking.vector_search(df, df.where("vec_id % 10 = 0"), 4).collect()
    monkeypatch.setattr(ranking, "TILE_BYTES", 48)
    monkeypatch.setattr(ranking, "CELLS", 5)
    got = ranking.vector_search(df.repartition(3), df.where("vec_id % 10 = 0"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 24


def test_bm25_with_many_asked_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red red hen"), (3, None), (4, "blue sky")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red fox red"), (8, "green")], "query_id long, text string")
    want = sorted(map(tuple, ranking.bm25_search(docs, asked, 5).collect()))
    monkeypatch.setattr(ranking, "ASKED_WORDS", 1)
    assert sorted(map(tuple, ranking.bm25_search(docs, asked, 5).collect())) == want and [x[:2] for x in want] == [(7, 1), (7, 2)]


def test_all_abstention_reasons(spark):
    queries = spark.createDataFrame([(i, "identifier" if i == 6 else "global" if i == 7 else "semantic") for i in range(1, 9)], "query_id int, kind string")
    rows = [(2, "dense", 1, 0.9, "quarantined"), (3, "dense", 1, None, "trusted"), (4, "other", 1, 0.9, "trusted"), (5, "dense", 1, 0.1, "trusted"), (6, "dense", 1, 0.9, "trusted"), (7, "dense", 1, 0.9, "trusted"), (8, "dense", 1, 0.9, "reviewed")]
    got = context.abstention(queries, spark.createDataFrame(rows, "query_id int, lane string, id int, score double, trust string"), {"dense": 0.3}, ("lexical",))
    assert [r.reason for r in got.orderBy("query_id").collect()] == ["no_evidence", "unsafe_evidence", "invalid_evidence_score", "uncalibrated_lane_evidence", "all_evidence_below_lane_threshold", "identifier_requires_lexical_evidence", "insufficient_distinct_documents", "sufficient_evidence"]


def test_composition_against_a_plain_loop(spark):
    def cost(s):
        return -(-sum(ord(c) < 128 for c in s) // 4) + sum(ord(c) >= 128 for c in s)

    r = np.random.default_rng(1)
    rows = [(q, i, i + 1, "src", "".join(r.choice(list("abc é漢")) for _ in range(r.integers(0, 60)))) for q in range(20) for i in range(5)]
    got = {}
    for x in context.composed(spark.createDataFrame(rows, "query_id long, id long, place int, source string, text string"), 70).collect():
        got.setdefault(x.query_id, {})[x.id] = (x.chars, x.cut)
    for q in range(20):
        whole, want = "", {}
        for _, i, place, source, text in (x for x in rows if x[0] == q):
            head = ("\n\n" if whole else "") + f"[{place}] {source}\n"
            if cost(whole + head + text) <= 70:
                whole += head + text
                want[i] = (len(text), False)
                continue
            n = max([k for k in range(len(text) + 1) if cost(whole + head + text[:k]) <= 70], default=0)
            if n:
                want[i] = (n, True)
            break
        assert got.get(q, {}) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(5, 5), (300, 299), (299, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), kept).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(200, 240)} == {7} and got[5] == 5 and got[300] == got[299] == 299
    assert graph.components(spark.createDataFrame([], "a long, b long"), kept).count() == 0


def plain_packed(text, size, overlap):
    """The overlap begins after the last sentence end of the tail, but only where that lies past half of it."""
    import re

    out, open_ = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if open_ and len(open_) + len(p) > size:
            out.append(open_.strip())
            tail = open_ if len(open_) <= overlap else open_[len(open_) - overlap :]
            last = max(tail.rfind(c) for c in "。！？.!?")
            open_ = tail[last + 1 :] if len(open_) > overlap and last > overlap * 0.5 else tail
        open_ += ("\n\n" if open_ else "") + p
    return [*out, open_.strip()] if open_.strip() else out


def test_packed_paragraphs_against_a_plain_loop(spark):
    r = np.random.default_rng(2)
    texts = ["", "one", "a\n\n\nb", "\n\n".join(["x" * 30 + ". " + "y" * 60 + ". Z" * 3] * 4), "\n\n".join(["q" * 90 + "."] * 3), "ends. Early " + "w" * 90 + "\n \n" + "v" * 70] + ["\n\n".join(" ".join(r.choice(["word", "end.", "Is it?", "漢字。"]) for _ in range(r.integers(1, 12))) for _ in range(r.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for x in df.select("i", T.packed_paragraphs(F.col("t"), 80, 25).alias("c")).collect():
        assert x.c == plain_packed(texts[x.i], 80, 25), texts[x.i]
    assert QUERIES["f6_packed_paragraphs"](spark, SF).count() >= 200


def test_text_functions_on_edges(spark):
    t = F.col("t")
    assert one(spark, T.utf16_prefix(t, 3), t="ab\U0001f600c") == "ab" and one(spark, T.utf16_prefix(t, 4), t="ab\U0001f600c") == "ab\U0001f600" and one(spark, T.utf16_prefix(t, 9), t="x") == "x"
    assert one(spark, T.nfkc(t), t="ﬁ①") == "fi1" and one(spark, T.fnv1a(t), t="") == 2166136261 and one(spark, T.fnv1a(t), t="a") == 0xE40C292C
    assert sorted(one(spark, T.graph_tokens(t), t="什么 知识图 a the x2")) == sorted(["知识图", "知", "识", "图", "知识", "识图", "什", "么", "x2", "什么"])
    assert one(spark, T.tokens_chat(t), t="知识图谱abc") == 4 and one(spark, T.preprocessed(t), t="a \r\n\r\n\r\n\r\n b") == "a\n\nb"
    assert one(spark, V.similarity(t, "COSINE"), t=-0.25) == 1.25 and one(spark, V.similarity(t, "COSINE"), t=0.5) == 0.5 and one(spark, V.similarity(t, "L2"), t=1.0) == 0.5
    assert one(spark, V.entropy(t), t=[0.0, 0.0]) == 0 and one(spark, V.entropy(t), t=[1.0, -1.0]) == 1 and one(spark, V.cosine(t, t), t=[0.0, 0.0]) == 0


def test_gate_takes_null_as_broken(spark):
    s = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert [r.code for r in evaluation.gate(s, [("A", "a", "=", 1.0), ("B", "b", ">=", 0.5), ("C", "a", ">=", 2.0)]).collect()] == ["B", "C"]


def test_order_statistics_against_sorted_lists(spark):
    import math
    import random
    from fractions import Fraction

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None, "c"]), r.choice([None, 1, 7, 7, 7, r.randrange(1000)]), "x") for _ in range(3000)] + [("only", 5, "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "g string, v int, _n string").repartition(5)
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    groups = {}
    for g, v, _ in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for down in (False, True):
        got = {x.g: tuple(x[n] for n in shares) for x in aggregates.order_statistics(df, ["g"], "v", shares, down).collect()}
        assert got == {g: tuple(sorted(v, reverse=down)[max(1, math.ceil(Fraction(str(p)) * len(v))) - 1] for p in shares.values()) for g, v in groups.items()}
    every = sorted(v for own in groups.values() for v in own)
    assert aggregates.order_statistics(df, [], "v", {"m": 0.5}).first().m == every[math.ceil(len(every) / 2) - 1]
    assert aggregates.order_statistics(df.where("v IS NULL"), ["g"], "v", shares).count() == 0 == aggregates.order_statistics(df.limit(0), [], "v", shares).where("p0 IS NOT NULL").count()


def test_queries_without_hits_score_nothing(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("b", 5, 1)], "query_id string, id long, rank int")
    gold = spark.createDataFrame([("a", 1, 1), ("nowhere", 7, 1)], "query_id string, id long, relevance int")
    got = {r.query_id: (r.recall, r.mrr) for r in evaluation.retrieval_metrics(ranked, gold, 5).collect()}
    assert got["a"] == (1.0, 1.0) and got["nowhere"] == (0.0, 0.0) and got["b"] == (None, None)


def test_nearest_centers_in_any_tiles(spark, monkeypatch):
    r = np.random.default_rng(6)
    x, c = r.normal(size=(200, 5)), r.normal(size=(40, 5))
    c[7] = c[3]
    rows = spark.createDataFrame([(i, [float(y) for y in v], "k") for i, v in enumerate(x)] + [(900, None, "k")], "id long, v array<double>, label string").repartition(3)
    centers = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in enumerate(c)], "cid long, w array<double>")
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, c))
    want = {i: int(n) for i, n in enumerate(np.round(u @ w.T, 12).argmax(axis=1))}
    for tile in (16 << 20, 400):
        monkeypatch.setattr(ranking, "TILE_BYTES", tile)
        assert {n.id: n.center for n in ranking.nearest_center(rows, centers, "id", "v", "cid", "w", ["label"]).collect()} == want


def test_recursive_chunks():
    from sedge.functions.splitting import recursive_chunks

    def texts(t, size, overlap):
        return [t[a:b] for a, b in recursive_chunks(t, size, overlap)]

    assert texts("aaa bbb ccc ddd", 7, 3) == ["aaa bbb", "ccc", "ddd"]
    assert texts("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert texts("one. two. three", 9, 0) == ["one. two", ". three"] and texts("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    assert texts("p one\n\np two\n\nlonger than that", 12, 0) == ["p one\n\np two", "longer than", "that"] and texts("", 5, 0) == []
    r = np.random.default_rng(5)
    for _ in range(200):
        t = "".join(r.choice(list("ab .\n。é"), 120))
        spans = recursive_chunks(t, 20, 6)
        assert all(0 < b - a <= 20 for a, b in spans) and all(x[0] < y[0] or x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(i in covered or t[i].isspace() for i in range(len(t)))


def test_pages(spark):
    import re

    from sedge.functions.splitting import pages_of

    def plainly(t):
        if "\f" in t:
            return [s.strip() for s in t.split("\f") if len(s.strip()) >= 20]
        parts = re.split(r"\n(?=#{1,3}\s)", t)
        if len(parts) > 1:
            return [s.strip() for s in parts if len(s.strip()) >= 20]
        pages, held = [], ""
        for p in re.split(r"\n{2,}", t):
            held += ("\n\n" if held else "") + p.strip()
            if len(held) >= 60:
                pages, held = [*pages, held], ""
        return ([*pages, held.strip()] if len(held.strip()) >= 20 else pages) or [t]

    r = np.random.default_rng(4)
    made = ["".join(r.choice(["word ", "\n\n", "\n\n\n", "# ", "\n# t ", "longer words here "] + ["\f"] * (k % 3 == 0), 30)) for k in range(60)] + ["", "short"]
    got = {x.i: x.p for x in spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", pages_of(F.col("t"), 60).alias("p")).collect()}
    assert got == {i: plainly(t) for i, t in enumerate(made)}
    assert QUERIES["s13_pages"](spark, SF).count() >= 200 and QUERIES["f4_recursive_chunks"](spark, SF).count() >= 200
