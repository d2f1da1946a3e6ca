"""All stages over the whole smallest tables against plain versions of each."""

import re

import corpus_pipeline
import duckdb
import numpy as np
from sedge.llm import decontaminate, pieces
from sedge.llm.queries import OP3, TOKENIZERS
from test_neardup import brute as near_brute
from test_text_operators import plain as base_spans
from test_text_operators import plain_bootstrap

SF = "/root/testdata/sf0.001"


def holding(texts, item, most):
    """Which texts hold item within ``most`` edits: rows of the whole edit distance over all texts at once."""
    gap = "\x00" * (most + 1)
    data = np.array(list(map(ord, gap.join(texts))), np.int32)
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    steps = np.arange(len(data) + 1, dtype=np.int32)
    row = np.zeros(len(data) + 1, np.int32)
    for k, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (data != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return {int(np.searchsorted(ends, at - 1, "right")) for at in np.flatnonzero(row[1:] <= most) + 1}


def redacted(text, spans):
    out, at = "", 0
    for a, b, kind in sorted(spans, key=lambda s: s[0]):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline():
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS FROM read_parquet('{SF}/{name}.parquet')")
    texts = dict(c.sql("SELECT doc_id, text FROM documents").fetchall())
    kept = {d for d, ok in c.sql(f"SELECT doc_id, kept FROM ({OP3})").fetchall() if ok}
    one = {d: k for d, (_, _, k) in near_brute([(d, texts[d]) for d in sorted(kept)], 5).items()}
    kept = sorted(d for d in kept if one[d])
    normal, gone = [decontaminate.normal(texts[d]) for d in kept], set()
    for (item,) in c.sql("SELECT text FROM benchmark").fetchall():
        item = decontaminate.normal(item)
        if item:
            gone |= holding(normal, item, len(item) * 5 // 100)
    kept = [d for k, d in enumerate(kept) if k not in gone]
    own = [texts[d] or "" for d in kept]
    more = plain_bootstrap(own)
    clean = {d: redacted(t, [*base_spans(t), *m]) for d, t, m in zip(kept, own, more)}
    codec = pieces.Codec(pieces.Vocabulary.read(f"{TOKENIZERS}/piece_bpe_32k.model"))
    return {d: [i for p in re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁")) for i in codec.best(p)] if t else [] for d, t in clean.items()}


def test_whole_tables(spark):
    want = plain_pipeline()
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and len(want) > 30
    assert all(got[d] == ids for d, ids in want.items())


def test_the_plain_distance():
    assert holding(["xxabcdexx", "abXde", "", "a b c"], "abcde", 1) == {0, 1} and holding(["ab"], "abc", 1) == {0} and holding(["zzz"], "abc", 1) == set()
