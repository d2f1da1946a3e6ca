"""Each query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from sedge.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in values), key=lambda r: tuple(map(repr, (round(x, 4) if isinstance(x, float) else x for x in r))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    rel = c.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) if isinstance(x, float) and y is not None else x == y for x, y in zip(g, w, strict=True)), (g, w)


def test_mmr_takes_the_best_first(spark):
    got = QUERIES["r6_mmr"](spark, SF).toPandas()
    assert (got.groupby("query_id").size() == 10).all()
    assert (got[got.position == 1].query_id == got[got.position == 1].id).all()


def test_whole_tables_are_counted(spark):
    d = QUERIES["g24_term_frequency_corpus"](spark, SF).select("doc_id").distinct()
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[A-Za-z0-9_]'")
    assert d.count() == texts.select("doc_id").distinct().count() > texts.where("lang = 'en'").count()
    assert QUERIES["g4_distribution_all_types"](spark, SF).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_whole_graph_and_store(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    info = QUERIES["g29_graph_info_whole"](spark, SF).first()
    assert info.edges == lines.select("l_suppkey", "l_partkey").distinct().count()
    assert info.nodes == lines.select("l_suppkey").distinct().count() + lines.select("l_partkey").distinct().count() and info.labels == ["part", "supplier"]
    assert QUERIES["k9_upsert_all_orders"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
