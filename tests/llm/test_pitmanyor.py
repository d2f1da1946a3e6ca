import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from sedge.llm.pitmanyor import CONTEXT, PARENT, score_texts

DDL = "doc_id long, text string, learn string, score int"


def test_counts_and_base(spark):
    texts = [None, "", "A b b", "a  c\tü", "b " * 4000, "zz unseen yy"] + [f"a b w{i % 7} c" for i in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, "A b b", "x", 1), (None, "b of none", "x", 1)]
    toks = {i: (t or "").lower().split() + ["\n"] for i, t, *_ in rows}
    held = {i for i in toks if i is not None and crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, _, _, _ in rows if i not in held for w in toks[i])
    n, v = sum(c.values()), len(c)
    got = score_texts(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in rows) and held
    for r in got:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert score_texts(spark.createDataFrame([], DDL)).count() == 0
    alone = score_texts(spark.createDataFrame(rows, DDL), held_out=F.lit(True)).collect()
    assert len(alone) == len(rows) and all(r.score == 0 and r.train_tokens == 0 for r in alone)


def textbook(docs, sweeps, burn, rng):
    """Chinese restaurants seated customer by customer: {(context, word): averaged chance}; None is the unknown word."""
    (d, s), (d0, s0) = CONTEXT, PARENT
    seats = []  # [context, word, table]
    sizes = defaultdict(lambda: defaultdict(dict))  # context -> word -> table -> customers
    parent, fresh = Counter(), iter(range(10**9))

    def chance(w):
        return (parent[w] - d0) / (s0 + sum(parent.values())) if parent[w] else 0.0

    def sit(c, w):
        t = sizes[c]
        tables = sum(len(x) for x in t.values())
        if not parent[w]:
            new = 1.0
            options = []
        else:
            new = (s + d * tables) * chance(w)
            options = [(k, n - d) for k, n in t[w].items()]
        u = rng.random() * (new + sum(x for _, x in options))
        for k, x in options:
            if u < x:
                t[w][k] += 1
                return k
            u -= x
        k = next(fresh)
        t[w][k] = 1
        parent[w] += 1
        return k

    for doc in docs:
        for c, w in zip([None, *doc], doc, strict=False):
            seats.append([c, w, sit(c, w)])
    vocabulary = sorted(parent)
    mean, kept = defaultdict(float), sweeps - burn
    for k in range(sweeps):
        for x in seats:
            c, w, t = x
            sizes[c][w][t] -= 1
            if not sizes[c][w][t]:
                if parent[w] == 1:  # its only table: the word stays known
                    sizes[c][w][t] = 1
                    continue
                del sizes[c][w][t]
                parent[w] -= 1
            x[2] = sit(c, w)
        if k >= burn:
            total = sum(parent.values())
            for c in sizes:
                n = sum(sum(t.values()) for t in sizes[c].values())
                tables = sum(len(t) for t in sizes[c].values())
                for w in [*vocabulary, "unknown"]:
                    own = sum(x - d for x in sizes[c][w].values()) if w in sizes[c] else 0.0
                    p0 = chance(w) if w != "unknown" else (s0 + d0 * len(vocabulary)) / (s0 + total)
                    mean[c, w] += (own + (s + d * tables) * p0) / (s + n) / kept
    return mean


def test_chances_against_the_textbook_sampler_and_their_sum(spark):
    r = random.Random(3)
    docs = [[r.choice("aaaabbbcd") for _ in range(r.randint(2, 12))] + ["\n"] for _ in range(60)]
    want = textbook(docs, 700, 100, np.random.default_rng(4))
    train = [(i, " ".join(d[:-1]), "x", 1) for i, d in enumerate(docs)]
    vocabulary = [*"abcd", "unknown"]
    asked = [(1000 + k, f"{c} {w}", "x", 1) for k, (c, w) in enumerate((c, w) for c in "abcd" for w in vocabulary)] + [(2000 + k, c, "x", 1) for k, c in enumerate("abcd")]
    got = {x.doc_id: x.token_scores for x in score_texts(spark.createDataFrame(train + asked, DDL), held_out=F.col("doc_id") >= 1000, sweeps=14, burn=3, by_token=True).where("held_out").collect()}
    off = []
    for k, c in enumerate("abcd"):
        p = {w: 10 ** got[1000 + 5 * k + j][1] for j, w in enumerate(vocabulary)} | {"\n": 10 ** got[2000 + k][1]}
        assert abs(sum(p.values()) - 1) < 1e-9
        off += [abs(p[w] - want[c, w]) for w in p]
    # eleven sweeps' mean has a spread of about .01 itself
    assert len(off) == 24 and max(off) < 0.025 and sum(off) / len(off) < 0.006, off


def test_parts_and_files_change_nothing(spark):
    """One seed gives one result, however the rows are dealt."""
    train = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 40)), "x", 1) for i in range(80)]
    df = spark.createDataFrame(train, DDL)
    a, b = (sorted((x.doc_id, round(x.score, 9)) for x in score_texts(df.repartition(k)).collect()) for k in (1, 7))
    assert a == b


def test_better_than_the_base_on_held_out_documents(spark):
    df = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    own = df[df.held_out]
    assert len(df) == 1000 and own.score.sum() > own.base_score.sum()
    assert (df[~df.held_out].score.sum() / df[~df.held_out].n_tokens.sum()) > own.score.sum() / own.n_tokens.sum()
