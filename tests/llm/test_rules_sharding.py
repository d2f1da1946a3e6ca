import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from sedge.llm.rules import MEASURES, host_verdicts, quality_rules
from sedge.llm.sharding import permuted, shard

DDL = "doc_id long, text string, source string, rejected string, _row int"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(words, words[1:], words[2:]))
    hot = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hot)


def test_measures(spark):
    texts = [None, "", " \n\t", "a", "é# ü| <x>", "a b c a b c", "x\nx\n\nx \n x\ny", "one two\r\none two\r\nthree", "w " * 3000, " ".join(f"w{i}" for i in range(80)), "ab\n" * 9 + "ab", "a b c\x0bd\x0ca b c"]
    rows = [(i, t, None, "r", 0) for i, t in enumerate(texts)] + [(3, "a", None, "r", 0)]
    got = quality_rules(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[m] for m in MEASURES) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert quality_rules(spark.createDataFrame([], DDL)).count() == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, f"good{i % 9}", "", 0) for i in range(270)] + [(1000 + i, good if i % 10 == 0 else "x y", "bad", "", 0) for i in range(200)] + [(2000, "x", "tiny", "", 0), (2001, good, "tiny", "", 0), (2002, good, "tiny", "", 0)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DDL)).collect()}
    assert not any(got[1000 + i].kept for i in range(200))
    assert all(got[i].kept for i in range(270)) and got[2001].kept and not got[2000].kept


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000):
        df = spark.range(n).select(permuted(F.col("id"), n, 3).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shards(spark):
    rows = [(i, f"t{i}", "s", "", 0) for i in range(997)] + [(5, "t5", "s", "", 0)] * 50 + [(None, None, None, None, None)] * 3
    carry = {"size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long")}
    out = [
        sorted(map(tuple, shard(spark.createDataFrame(r, DDL).repartition(k), 8, 1, carry=carry).select("shard", "slot", "doc_id", "size").collect()), key=lambda x: x[:2])
        for r, k in ((rows, 1), (rows[::-1], 7))
    ]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    slots = defaultdict(list)
    for s, t, *_ in out[0]:
        slots[s].append(t)
    assert set(slots) == set(range(8)) and all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [x[2] for x in out[0][:20]] != sorted(x[2] for x in out[0][:20] if x[2] is not None)
    assert shard(spark.createDataFrame([], DDL), carry=carry).count() == 0


def test_places_against_a_plain_permutation(spark):
    """Rows in order, numbered, and sent through the network written out in plain numbers."""
    import math

    rows = [(i * 7 % 1009, f"t{i}", "s", "", 0) for i in range(1009)] + [(None, "n", "s", "", 0)]
    df = spark.createDataFrame(rows, DDL)
    n, seed = len(rows), 5
    width = math.isqrt(n - 1) + 1
    height = -(-n // width)
    hashes = {(r.k, r.x): r.h for r in spark.range(max(width, height)).selectExpr("explode(sequence(0, 5)) k", "id x").select("k", "x", F.xxhash64(F.lit(seed), "k", "x").alias("h")).collect()}

    def network(x):
        left, right = x // width, x % width
        for k in range(6):
            if k % 2:
                right = (right + hashes[k, left] % width) % width
            else:
                left = (left + hashes[k, right] % height) % height
        return left * width + right

    def walked(x):
        x = network(x)
        while x >= n:
            x = network(x)
        return x

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {r[0]: (walked(k) % 8, walked(k) // 8) for k, r in enumerate(order)}
    got = {r.doc_id: (r.shard, r.slot) for r in shard(df, 8, seed).collect()}
    assert got == want


def test_first_row_numbers_of_partitions(spark):
    from sedge.llm.sharding import numbered

    df = spark.range(5000).selectExpr("id % 3 k", "id")
    got, n = numbered(df, F.col("k"), F.col("id"))
    assert n == 5000 and [r.id for r in got.orderBy("_row").collect()] == sorted(range(5000), key=lambda i: (i % 3, i))
    assert sorted(r._row for r in got.collect()) == list(range(5000))
