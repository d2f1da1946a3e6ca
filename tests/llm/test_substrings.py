import random

import xxhash

from sedge.llm.substrings import COVER, PERIOD, remove_repeats


def brute(rows, n=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen:
                gone.update(range(i, i + n))
            seen.add(w)
        out[doc_id] = (len(words), len(gone), b" ".join(x for k, x in enumerate(words) if k not in gone).decode())
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, seg string, bucket int")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, **more).collect()}


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_brute_force(spark):
    r = random.Random(5)
    passages = [[f"p{k}_{i}" for i in range(r.randint(15, 60))] for k in range(6)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(r.randint(0, 5)):
            words += [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
            words += r.choice(passages)[r.randint(0, 6) :]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "x " * 5000), (204, rows[7][1]), (205, rows[7][1]), (206, "é ü " * 30)]
    got = run(spark, [(*x, "s", 1) for x in rows])
    assert got == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_repeated_and_null_ids(spark):
    """The order of rows of one id hangs on their texts alone, and a null id comes last."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: r.randint(20, 60)] + [f"t{k}"]) for k in range(40)]
    rows = [(r.choice([1, 7, 7, 9, None]), t) for t in texts] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, None)]
    key = lambda x: (x[0] is None, x[0] or 0, (xxhash.xxh64_intdigest(x[1] or "", 42) + (1 << 63)) % (1 << 64))
    seen, want = set(), []
    for d, t in sorted(rows, key=key):
        words = (t or "").split()
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        want.append((d, len(words), len(gone), " ".join(x for k, x in enumerate(words) if k not in gone)))
    for parts in (1, 5):
        df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, rank int, bucket string").repartition(parts)
        got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in remove_repeats(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
