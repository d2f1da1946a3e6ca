import random

from sedge.llm.neardup import least_matches, near_duplicates


def brute(rows, n):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = set(zip(*(w[k:] for k in range(n)))) or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def run(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' rep", "1 band", "2L component")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, n).collect()}


def test_posterior():
    assert least_matches(80)[0] < 0.6 * 32 and list(least_matches(80)) == sorted(least_matches(80))


def test_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(3, 200))]
        for _ in range(r.randint(1, 12)):
            t = [r.choice(vocab) if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
            rows.append((d := d + 1, r.choice([" ", "\n"]).join(t).replace("w1", r.choice(["w1", "W1"]))))
    rows += [(900, None), (901, ""), (902, " "), (903, "One"), (904, "one"), (905, "one two"), (906, "two"), (907, "a b c d"), (908, "a B c d"), (909, "a b c")]
    for n in (2, 5):
        assert run(spark, rows, n) == brute(rows, n)


def test_chain_of_copies(spark):
    """Neighbours in a chain are linked, the others not: a star alone would lose links."""
    words = [f"c{i}" for i in range(700)]
    rows = [(100 - k, " ".join(words[k * 8 : k * 8 + 90])) for k in range(40)]
    got = run(spark, rows, 2)
    assert got == brute(rows, 2) and len({c for _, c, _ in got.values()}) == 1


def test_empty(spark):
    assert run(spark, [], 2) == {}


def test_large_band_is_cut_into_cells(spark, monkeypatch):
    from sedge.llm import neardup

    monkeypatch.setattr(neardup, "CELL", 7)
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(d, " ".join(r.choice("xyz") + str(r.random()) if r.random() < 0.07 else w for w in base)) for d in range(60)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_a_bucket_is_about_one_cell(spark, monkeypatch):
    """One band of 480 members in cells of 16: the copies, 14,400 rows, count for the buckets, not the 480."""
    import pyarrow as pa
    from sedge.llm import neardup

    def seen(rows, per_cent):
        return pa.table({"a": [len(rows)], "b": [0]})

    monkeypatch.setattr(neardup, "CELL", 16)
    monkeypatch.setattr(neardup, "_cell_pairs", seen)
    tagged = spark.range(480).selectExpr("7L band", "id doc_id", "id component")
    profiles = spark.range(480).selectExpr("id doc_id", "cast('' as binary) profile", "0L over")
    sizes = [r.a for r in neardup._met_in_cells(tagged, profiles, 80).collect()]
    assert sum(sizes) == 480 * 30 and max(sizes) <= 16 * 16


def test_members_of_a_hot_band_meet_by_rare_shingles(spark, monkeypatch):
    """Texts that share 70 of 100 words are no copies; those of a band need not all meet, and the copies among them are found."""
    from sedge.llm import neardup

    met, cells = [], neardup._met_in_cells

    def seen(tagged, profiles, per_cent):
        met.append(max(r["count"] for r in tagged.groupBy("band").count().collect()))
        return cells(tagged, profiles, per_cent)

    monkeypatch.setattr(neardup, "CELL", 7)
    monkeypatch.setattr(neardup, "_met_in_cells", seen)
    same = " ".join(f"s{i}" for i in range(70))
    rows = [(d, same + " " + " ".join(f"o{d // 2}_{i}" for i in range(30)) + " end" * (d % 2)) for d in range(400)]
    got = run(spark, rows, 2)
    assert got == brute(rows, 2) and len({c for _, c, _ in got.values()}) == 200
    assert met and max(met) <= 7


def test_repeated_and_null_ids(spark):
    """Rows of one id are one document; a null id links nothing."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(2, a), (3, b), (5, a), (5, b), (5, ""), (7, c), (7, c), (9, a + " end"), (11, "one"), (11, None), (None, a), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 5, 9)} == {2} and {r.component_id for r in got if r.doc_id == 7} == {7} and {r.component_id for r in got if r.doc_id == 11} == {11}
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (29, None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
