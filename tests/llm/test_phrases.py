import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from sedge.llm import phrases
from sedge.llm.queries import ORACLES, QUERIES

ROW = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def plain(rows, least, longest=4, top=2000):
    """Counts of all runs of words, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * count[p[i : i + m]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, k, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed=1, docs=120):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "é", "Straße", "a.b", "x", "in", "漢字", "big", "wide", "world"]
    weight = [30, 20, *[4] * 12]
    rows = []
    for _ in range(docs):
        out = []
        for _ in range(r.randint(0, 60)):
            out += r.choice([["new", "York", "city"], ["in", "the", "big", "wide", "world"], r.choices(words, weight), r.choices(words, weight)])
        rows.append((r.choice([" ", " ", "\t ", "  "]).join(w + r.choice(["", "", "", "", ".", "\n", ",", "\v"]) for w in out), r.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \n", "de"), ("one", "xx"), ("same words here " * 400, "yy"), (rows[0][0], rows[0][1])] + [("very common line of words", "en")] * 40


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, x, 1, "b") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, n int, word string").repartition(parts)


def same(df, want):
    assert [f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in df.schema] == ROW.split(", ")
    assert sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("budget", [1 << 20, 400, 20])
def test_against_plain_counts(spark, budget):
    """Budgets small enough that prefixes of one, two and three words are extended give the same rows."""
    rows = corpus()
    same(phrases.mine(frame(spark, rows), least=5, budget=budget), plain(rows, 5))


def test_small_pieces_of_text_and_few_rows(spark, monkeypatch):
    rows = corpus(2, 60)
    same(phrases.mine(frame(spark, rows), least=3, top=7, longest=3), plain(rows, 3, 3, 7))
    same(phrases.mine(frame(spark, rows), least=3, top=5, longest=2), plain(rows, 3, 2, 5))


def test_ties_are_ranked_by_phrase(spark):
    rows = [(f"p{i} q{i}, r{i} s{i}", "en") for i in range(60)] * 3
    got = phrases.mine(frame(spark, rows), least=3, top=50)
    same(got, plain(rows, 3, 4, 50))


def test_empty_table(spark):
    assert phrases.mine(frame(spark, corpus()).limit(0)).count() == 0
    assert phrases.mine(frame(spark, [(None, None), ("", "en")])).count() == 0


def test_query_same_as_sql_and_plain(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = plain(rows, 30)
    same(QUERIES["op13_phrases"](spark, path), want)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM read_parquet('{path}/documents.parquet')")
    rel = c.sql(ORACLES["op13_phrases"])
    assert rel.columns == [x.split()[0] for x in ROW.split(", ")] and sorted(rel.fetchall()) == want


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.call_function("div", F.lit(2_000_000).cast("decimal(20,0)") * F.lit(9 * 10**15).cast("decimal(18,0)"), F.lit(10**16 + 7).cast("decimal(19,0)"))).first()[0]
    assert got == 2_000_000 * 9 * 10**15 // (10**16 + 7)
