"""Keyed totals of a stream over restarts against counts of distinct rows."""

import random

from sedge.streaming import keyed

GROUPS = {"posts": ("post", "quote"), "comments": ("comment", "debate")}


def run(spark, path, base, schema):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    return {r.k: r for r in keyed.keyed_totals(stream, "k", "id", "kind", GROUPS, base).collect()}


def test_restarts_ignore_what_was_seen(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, None]), f"i{r.randrange(80)}", r.choice(["post", "quote", "comment", "like", None])) for _ in range(150)]
    parts = [rows[:70], rows[60:100] + rows[:10], [(9, "new", "debate")], rows[100:]]
    seen, kinds = {}, {}
    path, base = str(tmp_path), f"{tmp_path}/base"
    schema = spark.createDataFrame(rows, "k long, id string, kind string").schema
    for n, part in enumerate(parts):
        # which of the rows of one id comes first within a batch is open, so each has one kind
        part = [(k, i, kinds.setdefault((k, i), kind)) for k, i, kind in part]
        new = {(k, i): kind for k, i, kind in part if (k, i) not in seen}
        seen |= new
        spark.createDataFrame(part, schema).repartition(2).write.parquet(f"{path}/in/{n}")
        got = run(spark, path, base, schema)
        assert set(got) == {k for k, _ in seen}
        for key, row in got.items():
            own = [kind for (k, _), kind in seen.items() if k == key]
            assert (row.rows, row.posts, row.comments) == (len(own), sum(x in GROUPS["posts"] for x in own), sum(x in GROUPS["comments"] for x in own))
        written = spark.read.parquet(f"{base}/changes").where(f"batch = {n}")
        assert {x.key for x in written.collect()} == {"" if k is None else f"={k}" for k, _ in new}  # only keys that changed
    assert run(spark, path, base, schema)[9].batch == 2


def test_no_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, id string, kind string").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert run(spark, str(tmp_path), f"{tmp_path}/base", schema) == {}
