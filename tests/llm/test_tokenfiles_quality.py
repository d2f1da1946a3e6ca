import random
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from sedge.llm import quality, tokenfiles
from sedge.llm.quality import score_quality
from sedge.llm.queries import PATTERN, SEPARATOR, TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def test_scan_of_flat_files_at_any_block_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RUN", 3)
    r, want = random.Random(1), {}
    for k in range(5):
        ids, out = [], []
        for _ in range(r.randint(0, 12)):
            n = r.choice([0, 0, 1, 5, 40, 100])
            ids += [7] * n + [9]
            out.append(n)
        if k % 2 and (tail := r.randint(0, 30)):
            ids += [7] * tail
            out.append(tail)
        np.array(ids, "<u2").tofile(tmp_path / f"{k}.bin")
        want |= {(f"{k}.bin", i): n for i, n in enumerate(out)}
    for size in (2, 6, 64, 1 << 20):
        got = tokenfiles.count_tokens(spark, str(tmp_path), 9, size).collect()
        assert {(x.file, x.ordinal): x.n_tokens for x in got} == want and len(got) == len(want)


def test_documents(spark):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    texts = [None, "", "a b", "é" * 500, "Hello, world. " * 400, "x"]
    rows = [(i, t, "f", 3) for i, t in enumerate(texts)] + [(2, "a b", "f", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, n_tokens int")
    got = sorted((x.doc_id, x.n_tokens) for x in tokenfiles.document_token_counts(df, RANKS, PATTERN, SEPARATOR, block_bytes=64).collect())
    assert got == sorted((i, len(coder.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert tokenfiles.document_token_counts(df.limit(0), RANKS, PATTERN, SEPARATOR).count() == 0


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_quality(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert got.score.between(0, 1).all() and (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85


def test_quality_edges(spark):
    rows = [(i, "good words follow here in a row" if i % 2 else "### !!! ### !!!") for i in range(40)] + [(90, None), (91, ""), (92, "w " * 30000), (1, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(500, 1), (3, None), (None, 1), (7, 5)], "doc_id long, quality int")
    got = score_quality(docs, labels, held_out=F.col("doc_id") >= 30).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id < 40)
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_a_labelled_id_with_several_texts_is_fitted_with_one_of_them(spark):
    """The same one in any order and number of files."""
    rows = [(i % 40, f"{'good' if i % 2 else '###'} word{i} and more {i * 7}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string").repartition(parts)
        seen.add(tuple(sorted(round(r.score, 6) for r in score_quality(docs, labels).collect())))
    assert len(seen) == 1


def test_votes_against_plain_voting(spark):
    """Scores are those of a plain sum over every neighbour at or above the 25th cosine, ties by label order."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 5 == 0}
    fitted = sorted(d for d in known if d in texts and d not in held)
    counts = {d: np.concatenate(list(quality.term_counts(pa.record_batch([pa.array([t])], names=["text"]))))[0] for d, t in texts.items()}
    model = quality.fit(np.stack([counts[d] for d in fitted]), np.array([known[d] for d in fitted], np.float32))
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    assert len(fitted) > quality.NEIGHBOURS and set(got) == set(texts)
    for d in texts:
        v = model.project(counts[d][None])[0]
        cosines = [(float(np.dot(v, u)), -k) for k, u in enumerate(model.vectors)]
        near = sorted(cosines, reverse=True)[: quality.NEIGHBOURS]
        weights = [(max(c, 0.0) ** 8, model.labels[-k]) for c, k in near]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total > 1e-9 and counts[d].sum() else model.prior
        assert abs(got[d] - want) < 1e-3, (d, got[d], want)


def test_ties_at_the_last_neighbour():
    """Of equal cosines those of the smaller place count, so a copy's score does not hang on the block it is in."""
    n = quality.NEIGHBOURS
    vectors = np.zeros((2 * n, 2), np.float32)
    vectors[:, 0] = 1
    model = quality.Model(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, 2, dtype=np.float32), vectors, np.r_[np.ones(n), np.zeros(n)].astype(np.float32), 0.5)
    counts = np.zeros((3, quality.TERMS), np.float32)
    counts[:2, 0] = 4
    assert model.score(counts).tolist() == [1.0, 1.0, 0.5]


def test_ids_of_four_bytes(spark):
    """A separator beyond two bytes makes all ids four bytes long; the counts are the same."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b", "Hello, world. " * 400, "x"])], "doc_id long, text string")
    a, b = (sorted((x.doc_id, x.n_tokens) for x in tokenfiles.document_token_counts(df, RANKS, PATTERN, s, block_bytes=64).collect()) for s in (SEPARATOR, 1 << 20))
    assert a == b and len(a) == 5
