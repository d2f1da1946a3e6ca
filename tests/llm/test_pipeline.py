from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    clean = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(100))
    third = " ".join(f"u{i}" for i in range(100))
    item = "which letters follow the seventh word of this rather long question"
    rows = [
        (1, clean, "en", "a", 0), (2, clean + " x", "en", "a", 0), (3, "too short", "en", "a", 0), (4, None, "en", "a", 0),
        (5, other + " " + item.upper() + " " + other.upper(), "en", "b", 0), (6, third + " mail me@site.org now", "en", None, 0),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert [set(k) for k in kept] == [{1, 2, 5, 6}, {1, 5, 6}, {1, 6}, {1, 6}]
    assert kept[-1][6] == third + " mail [EMAIL] now"
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 6}


def test_rows_of_repeated_and_null_ids(spark, tmp_path):
    """Every row is judged by its own text; the caller's columns may have any name."""
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcdefgh"]
    item = "which letters follow the seventh word of this rather long question"
    rows = [
        (1, texts[0]), (1, texts[0]), (1, "too short"),
        (2, texts[1] + " " + item + " " + texts[1].upper()), (2, texts[2] + " mail me@site.org now"), (2, "to you@other.com " + texts[3]),
        (None, "too short"), (None, texts[4]), (None, texts[4]), (0, texts[4] + " x"),
        (None, texts[5] + " " + item), (None, texts[6] + " mail them@third.net now"),
    ]
    schema = "doc_id long, text string, spans string, Row_Key long, component_id string"
    spark.createDataFrame([(*r, "mine", 7, "own") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("source", F.lit(None).cast("string"))
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts == [10, 7, 5, 5]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect())
    assert got == sorted([(1, texts[0]), (2, texts[2] + " mail [EMAIL] now"), (2, "to [EMAIL] " + texts[3]), (0, texts[4] + " x"), (-1, texts[6] + " mail [EMAIL] now")])
    assert {(r.spans, r.Row_Key, r.component_id) for r in docs.collect()} == {("mine", 7, "own")}


def test_empty_table_and_very_long_text(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, ids string"
    spark.createDataFrame([(1, "which letters follow the seventh word of this rather long question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(60_000)) + " mail me@site.org"
    for k, rows in enumerate(([], [(1, long, "en", "a", 0, 1, "x"), (2, long + " twice", "en", "a", 0, 1, "x"), (3, "x" * 200_000, "en", "a", 0, 1, "x")])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert [r.doc_id for r in docs.collect()] == ([1] if rows else [])
