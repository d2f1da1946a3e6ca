import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from sedge.llm import alignment
from sedge.llm.queries import QUERIES, TOKENIZERS
from tokenizers import Tokenizer

PAIR = alignment.Pair(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces ", "Hello  world\n x", "\n  y\t z", "ünïcödé 漢字 \U0001f600​ é à", "tab\tend ", "x" * 3000, "The the THE", "▁mark", "a ▁ b", "\x00\x01", "<|endoftext|> </s> <s><unk><0x41>", "nb  sp　 q  r\u0085 s", "don't 'll 12 345,67 — ok", "é  à\n ß", "a" * 40 + " " * 70 + "b"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PAIR.a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PAIR.b_path)


def plain(libraries, text):
    """(A ids, B ids, groups, overlapping pairs, pairs that end together) of a whole text, one token at a time."""
    a, b = libraries
    if not text:
        return [], [], [], set(), set()
    letters = {v: k for k, v in alignment.byte_letters().items()}
    back = {v: k for k, v in letters.items()}
    want = (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False).ids
    xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
    y = b.encode(text)
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(xs) != want or b"".join(ys) != want:
        return [], [], [], set(), set()
    spans = []
    for side in (xs, ys):
        at, own = 0, []
        for t in side:
            own.append((at, at + len(t)))
            at += len(t)
        spans.append(own)
    both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, last = [], 0
    for e in both:
        groups.append(([i for i, s in zip(x, spans[0]) if last < s[1] <= e], [i for i, s in zip(y, spans[1]) if last < s[1] <= e]))
        last = e
    over = {(i, j) for i, s in enumerate(spans[0]) for j, t in enumerate(spans[1]) if s[0] < t[1] and t[0] < s[1]}
    return x, y, groups, over, {(i, j) for i, j in over if spans[0][i][1] == spans[1][j][1]}


def written(groups):
    return ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)


def some(n):
    r = random.Random(3)
    letters = ["the", " ", "  ", "\n", "ing", "é", "漢", "x1", "'s", ".", "</s>", "\t", "Straße", " ", "\U0001f600"]
    return TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_against_a_plain_alignment_of_whole_texts(spark, libraries):
    rows = [(i, t, 1, "x") for i, t in enumerate(some(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, a_ids int, links string").repartition(3)
    for links in ("ends", "overlaps"):
        got = {r.doc_id: r for r in alignment.align(df, alignment.Pair(PAIR.a_path, PAIR.b_path, links)).collect()}
        for i, text, *_ in rows:
            if links == "overlaps" and len(text or "") > 1000:
                continue
            x, y, groups, over, ends = plain(libraries, text)
            r = got[i]
            assert (r.a_ids, r.b_ids) == (x, y), text
            a_cuts, b_cuts = [0, *r.a_cuts], [0, *r.b_cuts]
            assert [(x[a_cuts[k] : a_cuts[k + 1]], y[b_cuts[k] : b_cuts[k + 1]]) for k in range(len(r.a_cuts))] == groups
            assert set(zip(r.link_a, r.link_b)) == (ends if links == "ends" else over) and len(r.link_a) == len(set(zip(r.link_a, r.link_b)))


def test_report_against_plain_counts(spark, libraries):
    texts = some(80) + ["the the the", "the the the"]
    rows = [(None if i % 17 == 16 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    solved = [plain(libraries, t) for t in texts]
    count = Counter((x[i], y[j]) for x, y, _, _, ends in solved for i, j in ends)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (d, _), (x, y, groups, _, ends) in zip(rows, solved):
        own = [(x[i], y[j]) for i, j in ends]
        sha = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        want.append((d, len(x), len(y), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), sha))
    got = alignment.link_report(df, PAIR)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert alignment.link_report(df.limit(0), PAIR).count() == 0


def test_intervals():
    r = random.Random(1)
    for _ in range(200):
        spans = [(s, s + r.randint(1, 5)) for s in (r.randint(0, 40) for _ in range(r.randint(0, 25)))]
        start, end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        got = alignment.coalesce(start, end)
        cover, want, number = set(), {}, 0
        for p in range(50):
            inside = [k for k, (s, e) in enumerate(spans) if s <= p < e]
            if p and not any(s < p < e for s, e in spans) and cover:
                number, cover = number + 1, set()
            cover |= set(inside)
            want |= {k: number for k in inside}
        assert got.tolist() == [want[k] for k in range(len(spans))]


def test_memory_is_let_go(spark, monkeypatch):
    own = alignment.Aligner(PAIR)
    import pyarrow as pa

    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    texts = [f"word{i} other{i} tail{i % 3}" for i in range(50)]
    whole = alignment.Aligner(PAIR).align(pa.array(texts))
    parts = [own.align(pa.array([t])) for t in texts]
    assert len(own.known) <= 23
    for k, column in enumerate(whole):
        assert column.to_pylist() == [p[k].to_pylist()[0] for p in parts]


def test_query_reads_all_rows(spark):
    got = QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.count() == docs.count() and got.where("n_links > 0 and n_best > 0").count() > 0
