"""Sub-words, merges and alignments against plain walks over whole tables."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F
from sedge.functions import subwords
from sedge.operators import spans
from sedge.plans import texts as plans
from sedge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return subwords.read_ranks(plans.RANKS)


def plain_merges(word, ranks):
    """All pairs are looked at again after each merge."""
    parts, steps = [(i, i + 1) for i in range(len(word))], []
    while True:
        found = [(ranks[word[a:c]], k) for k, ((a, _), (_, c)) in enumerate(zip(parts, parts[1:])) if word[a:c] in ranks]
        if not found:
            return [(ranks[word[a:b]], a, b) for a, b in parts], steps
        rank, k = min(found)
        (a, b), (_, c) = parts[k], parts[k + 1]
        steps.append((rank, a, b, c))
        parts[k : k + 2] = [(a, c)]


def test_merges_of_all_words(spark, ranks):
    words = set()
    for name in ("documents", "benchmark"):
        for r in spark.read.parquet(f"{SF}/{name}.parquet").select("text").collect():
            words |= {w.encode() for w in regex.findall(plans._WORDS, r.text or "")}
    r = random.Random(1)
    words |= {bytes(r.choice(b"abc the\xc3\xa9\xff") for _ in range(r.randrange(1, 60))) for _ in range(500)}
    assert len(words) > 5_000
    for w in words:
        assert subwords.merge_steps(w, ranks) == plain_merges(w, ranks), w


def test_ids_are_the_librarys_over_whole_documents(spark, ranks):
    import tiktoken

    coder = tiktoken.Encoding("x", pat_str=plans._WORDS, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stored = {x.doc_id: x.text for x in docs.collect()}
    for x in subwords.capture_merges(docs, ranks, plans._WORDS, "doc_id").collect():
        text = stored[x.doc_id]
        data = (text or "").encode()
        assert list(x.ids) == coder.encode_ordinary(text or "")
        assert b"".join(data[a:b] for a, b in zip(x.starts, x.ends)) == data
        assert all(data[a:b] and ranks[data[a:c]] == k for k, a, b, c in zip(x.ranks, x.lefts, x.middles, x.rights))
    got = {x.doc_id: x for x in QUERIES["x5_merge_capture"](spark, SF).collect()}
    for i, t in stored.items():
        assert got[i].tokens == len(coder.encode_ordinary(t or "")) and got[i].merges == len((t or "").encode()) - got[i].tokens
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "a a")], "doc_id long, text string")
    assert {x.doc_id: len(x.ids) for x in subwords.capture_merges(empty, ranks, plans._WORDS, "doc_id").collect()} == {1: 0, 2: 0, None: 2}


def plain_waterfall(text, vocabulary):
    """All starts of the rest of the text are looked up, shortest first."""
    longest, at, out = max(map(len, vocabulary)), 0, []
    while at < len(text):
        found = [text[at : at + n] for n in range(1, longest + 1) if at + n <= len(text) and text[at : at + n] in vocabulary]
        best, top = None, -1.0
        for t in found:
            i, rank, f = vocabulary[t]
            score = math.log(f + 1) / 10 * 0.7 + 1 / (rank + 1) * 0.3
            if best is None or score > top:
                best, top = t, score
        out.append((best, vocabulary[best][0], len(found), "merge" if len(found) > 1 else "split") if best else (text[at], ord(text[at]), 0, "fallback"))
        at += len(out[-1][0])
    return out


def test_waterfall_on_short_vocabularies(spark):
    r = random.Random(2)
    for _ in range(20):
        words = {"".join(r.choice("abé漢") for _ in range(r.randrange(1, 7))): (i, r.randrange(50), r.choice([0, 1, 5, 5, 900])) for i in range(30)}
        trie = subwords.Trie([subwords.Entry(t, *x) for t, x in words.items()])
        for _ in range(30):
            text = "".join(r.choice("abé漢x") for _ in range(r.randrange(0, 40)))
            assert list(trie.split(text)) == plain_waterfall(text, words)
            assert sum(1 for _ in trie.merges(text)) == sum(x[3] == "merge" for x in plain_waterfall(text, words))
    tie = subwords.Trie([subwords.Entry("a", 1, 4, 2), subwords.Entry("ab", 2, 4, 2)])
    assert list(tie.split("ab"))[0][:2] == ("a", 1) and list(tie.merges("ab")) == [("a", "ab", "a", 4)]


def test_waterfall_over_whole_documents(spark, ranks):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    often = Counter()
    for t in docs.values():
        for w in regex.findall(plans._WORDS, t):
            often.update(i for i, _, _ in subwords.merge_steps(w.encode(), ranks)[0])
    vocabulary = {}
    for token, i in ranks.items():
        try:
            vocabulary[token.decode()] = (i, i, often[i])
        except UnicodeDecodeError:
            pass
    got = {x.doc_id: x for x in QUERIES["x4_subword_waterfall"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in list(docs.items()):
        if len(text) < 20_000:
            rows = plain_waterfall(text, vocabulary)
            assert (got[i].tokens, got[i].merges, got[i].fallbacks) == (len(rows), sum(r[3] == "merge" for r in rows), sum(r[3] == "fallback" for r in rows))
            assert got[i].digest == hashlib.sha256(",".join(str(r[1]) for r in rows).encode()).hexdigest()


def plain_cover(own, length):
    return [next((k for k, (a, b) in enumerate(own) if a <= p < b), -1) for p in range(length)]


def test_covering_spans():
    r = random.Random(3)
    for _ in range(400):
        n = r.randrange(0, 30)
        own = [(a, a + r.randrange(0, 6)) for a in (r.randrange(-2, 32) for _ in range(r.randrange(0, 15)))]
        assert spans.covering(own, n) == plain_cover(own, n)


def plain_differences(tokens, cover, length):
    """Every position in turn, with a set of those that are done."""
    done, out = set(), []
    for i in range(length):
        own = {n: tokens[n][cover[n][i]] for n in tokens if cover[n][i] >= 0}
        if len(own) < 2 or i in done or len(set(own.values())) < 2:
            continue
        sizes = [len(re.sub("^##|^▁", "", t)) for t in own.values()]
        kind = "split_difference"
        if any("[UNK" in t or "[0x" in t for t in own.values()):
            kind = "unknown_handling"
        elif max(sizes) > min(sizes) * 1.5 and max(sizes) > 2:
            kind = "merge_difference"
        ratio = len(set(own.values())) / len(own)
        out.append((i, kind, "high" if ratio > 0.7 else "medium" if ratio > 0.4 else "low", {n: tokens[n][max(0, cover[n][i] - 1) : cover[n][i] + 2] for n in own}))
        done |= set(range(i, i + max(len(t) for t in own.values())))
    return out


def test_differences_and_consistency(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(r.choice(["a", "bc", " ", "##x", "▁y", "é"]) for _ in range(r.randrange(0, 25)))
        own = []
        for _ in range(3):
            at, cut = 0, []
            while at < len(text):
                n = r.randrange(1, 5)
                token = r.choice([text[at : at + n]] * 6 + ["[UNK:1]"])
                if r.random() < 0.9:
                    cut.append((token, at, min(len(text), at + n)))
                at += n
            own.append(cut)
        rows.append((i, text, *own))
    rows.append((99, None, None, [], None))
    kind = "array<struct<token:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, text string, a {kind}, b {kind}, c {kind}").repartition(2)
    got = {x.id: x for x in spans.tokenizer_differences(df, {"a": "a", "b": "b", "c": "c"}, "id").collect()}
    chars = {(x.id, x.position): x for x in spans.character_alignment(df, {"a": "a", "b": "b", "c": "c"}, "id").collect()}
    for i, text, *own in rows:
        text = text or ""
        tokens = {n: [t[0] for t in x or []] for n, x in zip("abc", own)}
        cover = {n: plain_cover([t[1:] for t in x or []], len(text)) for n, x in zip("abc", own)}
        want = plain_differences(tokens, cover, len(text))
        assert [(x.position, x.type, x.significance, x.models) for x in got[i].differences] == want
        for n in "abc":
            takes = [m for _, _, _, m in want if n in m]
            same = sum(sum("".join(v) == "".join(m[n]) for v in m.values()) > 1.5 for m in takes)
            assert got[i].consistency[n] == (same / len(takes) if takes else 1.0)
        for p in range(len(text)):
            assert (chars[i, p].character, *(chars[i, p][f"token_{n}"] for n in "abc")) == (text[p], *(tokens[n][cover[n][p]] if cover[n][p] >= 0 else None for n in "abc"))


def test_differences_over_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    read = {x.doc_id: x for x in plans._cut(docs).collect()}
    got = {x.doc_id: x for x in QUERIES["x14_differences"](spark, SF).collect()}
    assert set(got) == set(read)
    for i, x in read.items():
        tokens = {n: list(x[n] or []) for n in plans._CUTS}
        assert all("".join(t) == (x.text or "") for t in tokens.values())
        if len(x.text or "") > 4_000:
            continue
        own = {n: spans._read(t)[1] for n, t in tokens.items()}
        want = plain_differences(tokens, {n: plain_cover(o, len(x.text)) for n, o in own.items()}, len(x.text))
        assert (got[i].differences, got[i].high, got[i].merge) == (len(want), sum(w[2] == "high" for w in want), sum(w[1] == "merge_difference" for w in want)) and got[i].last == (want[-1][0] if want else None)


def test_kinds_of_tokens(spark):
    from sedge.functions import text as T

    said = {"[CLS]": "special", "[unk]x": "special", "abc": "english", "知识": "chinese", "知a": "special", "12": "number", "1a": "special", "?!-": "punctuation", "…": "special", "[x]": "special", "é": "special", "()[]": "punctuation"}
    df = spark.createDataFrame(list(said.items()), "t string, k string")
    assert df.where(T.token_kind(F.col("t")) != F.col("k")).count() == 0


def test_results_are_handed_on_in_pieces():
    assert list(subwords.in_pieces([], 5)) == []
    assert list(subwords.in_pieces(["abc", None, "ab", "a", "", "abcdefgh", "a"], 5)) == [(0, 3), (3, 5), (5, 6), (6, 7)]


def test_counts_of_differences_are_those_of_the_differences(spark):
    r = random.Random(6)
    rows = [(0, "", [], None), (1, None, [], []), (2, "ab", [], [("ab", 0, 2)])]
    for i in range(3, 60):
        text = "".join(r.choice("ab é漢") for _ in range(r.randrange(0, 30)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(0, 12)))
        words = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows.append((i, text, words[: r.choice([99, 99, 3])], [(text[k : k + 3], k, k + 3) for k in range(r.randrange(2), len(text), 3)]))
    df = spark.createDataFrame(rows, "id int, text string, a array<string>, b array<struct<token:string,start:int,end:int>>").repartition(3)
    whole = {x.id: x for x in spans.tokenizer_differences(df, {"a": "a", "b": "b"}, "id").collect()}
    for x in spans.difference_counts(df, {"a": "a", "b": "b"}, "id").collect():
        want, own = whole[x.id].differences, dict((i, (t or "", a, b)) for i, t, a, b in rows)[x.id]
        tokens = {"a": list(own[1]), "b": [t[0] for t in own[2] or []]}
        cover = {"a": plain_cover(spans._read(own[1])[1], len(own[0])), "b": plain_cover([t[1:] for t in own[2] or []], len(own[0]))}
        assert [(d.position, d.type, d.significance, d.models) for d in want] == plain_differences(tokens, cover, len(own[0]))
        kinds = [sum(d.type == k for d in want) for k in spans.TYPES]
        assert [x.differences, x.merge, x.split, x.unknown] == [len(want), *kinds] and x.high == sum(d.significance == "high" for d in want)
        assert x.last == (want[-1].position if want else None) and x.consistency == whole[x.id].consistency


def test_differences_of_many_characters_are_found_as_arrays():
    import time

    import pyarrow as pa

    text = "".join(random.Random(7).choice(["word", "or", " ", "  ", ", ", "x1"]) for _ in range(500_000))
    cut = [re.findall(p, text) for p in (r" ?[^ ]+| +", r"[a-z0-9]+|[^a-z0-9]", r".{1,3}")]
    columns = [pa.array([c]) for c in cut]
    at = time.process_time()
    counts = spans._Piece(spans.np.array([len(text)]), columns).consistency()
    assert time.process_time() - at < 4 and len(counts) == 3  # plain loops over characters take 8 s or more


def test_parts_of_texts_split_as_the_whole(ranks):
    r = random.Random(8)
    for _ in range(30):
        words = {"".join(r.choice("abé漢 ") for _ in range(r.randrange(1, 5))): (i, r.randrange(50), r.choice([0, 1, 5, 900])) for i in range(12)}
        trie = subwords.Trie([subwords.Entry(t, *x) for t, x in words.items()])
        for _ in range(30):
            text = "".join(r.choice("abé漢x \U0001f600") for _ in range(r.randrange(0, 40)))
            assert "".join(trie.parts(text)) == text and all(trie.parts(text))
            assert [x for rows in trie.by_part(text, tuple) for x in rows] == list(trie.split(text)) == plain_waterfall(text, words)
    trie = subwords.Trie([subwords.Entry(t.decode("latin-1"), i, i, 1) for t, i in ranks.items() if max(t) < 128])
    assert trie.parts("of words, and  more") == ["of", " words", ",", " and", " ", " more"]
    split, done = trie.split, []
    trie.split = lambda part: done.append(part) or split(part)
    assert trie.by_part("one two one two one two", tuple) == [tuple(split(w)) for w in ("one", *[" two", " one"] * 2, " two")]
    assert len(done) <= 4  # a part that was met is not gone through again


def test_ids_of_words_are_those_of_their_merges(ranks):
    r = random.Random(9)
    for _ in range(3_000):
        w = bytes(r.choice(b"abc the\xc3\xa9\xff") for _ in range(r.randrange(0, 100)))
        assert subwords.merged_ids(w, ranks) == [i for i, _, _ in subwords.merge_steps(w, ranks)[0]]


def test_counts_of_tokens_over_whole_documents(spark, ranks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = Counter(i for x in subwords.capture_merges(docs, ranks, plans._WORDS, "doc_id").collect() for i in x.ids)
    assert {x.id: x.n for x in subwords.token_counts(docs.repartition(3), ranks, plans._WORDS).collect()} == want
