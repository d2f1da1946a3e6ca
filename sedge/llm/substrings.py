"""Removing repeated word windows, found by difference-cover anchors.

Two equal windows of ``window`` words start at word i of one document and j of
another. COVER is a difference cover modulo PERIOD: some shift d < PERIOD puts
both i + d and j + d on cover positions. So the ``window - PERIOD + 1`` words
from there, the anchor, are equal too, and it is enough to compare the anchors that
start at cover positions (4 of 13). Windows that hold an anchor found twice are then
extended to their full length and compared whole; the first of equals stays.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .words import Words, flat, pieces

#: Every residue modulo 13 is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Packed hashes that one bucket compares at once.
BUCKET_ROWS = 1 << 20

#: Where a window stands in the order of documents.
_PLACE = np.dtype([("none", "u1"), ("id", "<i8"), ("rank", "<i8")])
_BLOCKS = pa.schema([("bucket", pa.int32()), ("seg", pa.int32()), ("hash", pa.binary()), ("more", pa.binary())])
_BITS = pa.schema([("seg", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
_DDL = {_BLOCKS: "bucket int, seg int, hash binary, more binary", _BITS: "seg int, bucket int, kind int, bits binary"}


def _ordered(docs: pa.Table) -> pa.Table:
    """By id, null ids last; rows of one id by a hash of their texts."""
    return docs.sort_by([("doc_id", "ascending"), ("rank", "ascending")])


def _anchors(docs: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ordered documents: for each anchor its hash and its word's index in the segment; the documents' word offsets."""
    text, offsets = flat(docs["text"])
    cover = np.isin(np.arange(PERIOD), COVER)
    hashes, words, base, at = [], [], 0, [np.zeros(1, np.int64)]
    for first, last in pieces(offsets):
        w = Words(text, offsets, first, last)
        start, h = w.windows(window - PERIOD + 1)
        own = w.doc[start]
        keep = cover[(start - w.at[own]) % PERIOD] & (np.diff(w.at)[own] >= window)
        hashes.append(h[keep])
        words.append(start[keep] + base)
        at.append(w.at[1:] + base)
        base += len(w.start)
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(hashes or empty[0]), np.concatenate(words or empty[1]), np.concatenate(at)


def _send_anchors(docs: pa.Table, window: int, buckets: int) -> pa.Table:
    h, counts = np.unique(_anchors(docs, window)[0], return_counts=True)
    seg = docs["seg"][0].as_py()
    return X.table(_BLOCKS, [(b, seg, h[i:j].tobytes(), X.pack_bits(counts[i:j] > 1)) for b, i, j in X.dealt(h, buckets)])


def _joined(blocks: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
    """Senders in order, their offsets, and all their hashes."""
    blobs = [np.frombuffer(x, np.uint64) for x in blocks["hash"].to_pylist()]
    return blocks["seg"].to_pylist(), np.cumsum([0, *map(len, blobs)]).tolist(), np.concatenate(blobs)


def _reply(blocks: pa.Table, kind: int, flags: np.ndarray, segs: list[int], at: list[int]) -> pa.Table:
    b = blocks["bucket"][0].as_py()
    return X.table(_BITS, [(s, b, kind, X.pack_bits(flags[at[k] : at[k + 1]])) for k, s in enumerate(segs)])


def _shared_anchors(blocks: pa.Table) -> pa.Table:
    segs, at, h = _joined(blocks)
    flags = [X.unpack_bits(x, at[k + 1] - at[k]) for k, x in enumerate(blocks["more"].to_pylist())]
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    twice = (n > 1) | (np.bincount(inverse, np.concatenate(flags)) > 0)
    return _reply(blocks, 1, twice[inverse], segs, at)


def _candidates(docs: pa.Table, replies: pa.Table, window: int, buckets: int):
    """Distinct hashes of the windows that hold a shared anchor, each one's first place, and the windows."""
    h, word, at = _anchors(docs, window)
    h, inverse = np.unique(h, return_inverse=True)
    shared = X.answers(replies, h, buckets)
    hot = word[shared[inverse]] if len(h) else word
    total = int(at[-1])
    reach = np.zeros(total + 1, np.int32)
    np.add.at(reach, np.maximum(hot - (PERIOD - 1), 0), 1)
    np.add.at(reach, hot + 1, -1)
    near = np.cumsum(reach[:-1]) > 0
    text, offsets = flat(docs["text"])
    hashes, starts, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for first, last in pieces(offsets):
        w = Words(text, offsets, first, last)
        if near[base : base + len(w.start)].any():
            start, g = w.windows(window)
            keep = near[start + base]
            hashes.append(g[keep])
            starts.append(start[keep] + base)
        base += len(w.start)
    g, start = np.concatenate(hashes), np.concatenate(starts)
    g, first, inverse = np.unique(g, return_index=True, return_inverse=True)
    return g, first, inverse, start, at


def _send_windows(docs: pa.Table, replies: pa.Table, window: int, buckets: int) -> pa.Table:
    docs = _ordered(docs)
    if len(docs) == 0:
        return X.table(_BLOCKS, [])
    g, first, _, start, at = _candidates(docs, replies, window, buckets)
    own = np.searchsorted(at, start[first], "right") - 1
    places = np.empty(len(g), _PLACE)
    places["none"], places["id"], places["rank"] = docs["doc_id"].is_null().to_numpy()[own], docs["doc_id"].fill_null(0).to_numpy()[own], docs["rank"].to_numpy()[own]
    seg = docs["seg"][0].as_py()
    return X.table(_BLOCKS, [(b, seg, g[i:j].tobytes(), places[i:j].tobytes()) for b, i, j in X.dealt(g, buckets)])


def _first_windows(blocks: pa.Table) -> pa.Table:
    segs, at, h = _joined(blocks)
    place = np.concatenate([np.frombuffer(x, _PLACE) for x in blocks["more"].to_pylist()])
    order = np.lexsort((np.repeat(segs, np.diff(at)), place["rank"], place["id"], place["none"], h))
    first = np.ones(len(h), bool)
    first[order[1:]] = h[order[1:]] != h[order[:-1]]
    return _reply(blocks, 2, first, segs, at)


def _strip(docs: pa.Table, replies: pa.Table, window: int, buckets: int, schema: pa.Schema) -> pa.Table:
    docs = _ordered(docs)
    if len(docs) == 0:
        return X.table(schema, [])
    kinds = replies["kind"].to_numpy()
    g, first, inverse, start, at = _candidates(docs, replies.filter(pa.array(kinds == 1)), window, buckets)
    leads = X.answers(replies.filter(pa.array(kinds == 2)), g, buckets)
    gone = np.ones(len(start), bool)
    gone[first[leads]] = False
    cover = np.zeros(int(at[-1]) + 1, np.int32)
    np.add.at(cover, start[gone], 1)
    np.add.at(cover, start[gone] + window, -1)
    removed = np.cumsum(cover[:-1]) > 0
    n_removed = np.diff(np.r_[0, np.cumsum(removed)][at])
    kept = []
    for k, text in enumerate(docs["text"].to_pylist()):
        words = (text or "").encode().split()
        if n_removed[k]:
            words = itertools.compress(words, (~removed[at[k] : at[k + 1]]).tolist())
        kept.append(b" ".join(words).decode())
    return pa.table([docs["doc_id"], pa.array(np.diff(at)), pa.array(n_removed), pa.array(kept)], schema=schema)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every word that a repeated window covers; returns doc_id, n_words, n_removed, kept_text.

    A window is ``window`` consecutive words of one document, judged on the input. It is a
    repeat if the same words start earlier: in a smaller doc_id, or further
    left in the same document. ``window`` is at least PERIOD.

    Null text: no words, kept_text "". Empty table: empty result. Shorter texts lose
    nothing; texts of any length are taken whole. Rows that share a doc_id count as separate documents in the order of a
    64-bit hash of their texts, so of equal rows one keeps its words; rows of a null id come after all others.
    Other columns are ignored, whatever their names. Windows are compared by 64-bit hashes.
    """
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = X.total_bytes(docs, "text")
    segments = max(4, size // X.SEGMENT_BYTES)
    buckets = max(4, size // 6 * len(COVER) // PERIOD // BUCKET_ROWS)
    # dealt by row, so rows that are equal are spread too
    segs = docs.select(X.segment(segments, F.col("doc_id"), F.monotonically_increasing_id()), "doc_id", F.xxhash64("text").alias("rank"), "text")
    whole = segs.groupBy("seg")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    sent = whole.applyInArrow(lambda t: _send_anchors(_ordered(t), window, buckets), _DDL[_BLOCKS])
    shared = sent.groupBy("bucket").applyInArrow(_shared_anchors, _DDL[_BITS])
    windows = whole.cogroup(shared.groupBy("seg")).applyInArrow(lambda d, r: _send_windows(d, r, window, buckets), _DDL[_BLOCKS])
    firsts = windows.groupBy("bucket").applyInArrow(_first_windows, _DDL[_BITS])
    replies = shared.unionByName(firsts)
    return whole.cogroup(replies.groupBy("seg")).applyInArrow(lambda d, r: _strip(d, r, window, buckets, out), "doc_id long, n_words long, n_removed long, kept_text string")
