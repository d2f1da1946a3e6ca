"""A hierarchical Pitman-Yor language model of word pairs.

Each context word has a restaurant whose customers are the tokens that follow it; their tables are customers of one
parent restaurant over single words, which all contexts share. The parent's own base has no two draws alike, so each of
its words has one table, and what is left is the chance of a word not seen before.

Seats are sampled by Gibbs sweeps over the joint state, each part from its full conditional:

1. the parent's distribution, given the tables of all contexts (a Dirichlet draw over its words and the unseen);
2. for each context a gamma variable given its tables, which makes its dishes independent of each other;
3. for each dish of each context, given 1 and 2, all its customers are seated anew (see seating): an exact draw.

So dishes may be drawn at the same time in any number of buckets without a departure from Gibbs sampling. A
word's probability is averaged over the sweeps after the first BURN.

Work is packed (see exchange): segments of documents send their distinct words to word buckets, and distinct pairs of
known words to pair buckets. Word buckets have the parent's words and the totals of contexts; pair buckets have
dishes. A context with more than SALT customers is in several buckets, which share its gamma variable. Words are told
apart by 64-bit hashes, and are numbered for what follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import seating
from .durable import checkpointed
from .words import U64, Words, flat, mix, pieces

#: Discount and strength of context restaurants and of their parent; sweeps, and those of them that are not averaged.
CONTEXT, PARENT, SWEEPS, BURN = (0.8, 2.0), (0.6, 10.0), 3, 1
#: Customers of a context for each bucket that has a part of its dishes; entries that a bucket holds.
SALT, BUCKET_ROWS = 1 << 20, 1 << 20
SEGMENT_BYTES = 10 << 20
END = U64(0xE0D0_0000_0000_0001)

_ROW = pa.schema([("key", pa.int32()), ("peer", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("x", pa.list_(pa.float64()))])
_DDL = "key int, peer int, kind int, a binary, b binary, c binary, d binary, x array<double>"
#: Kinds of rows. Keys are word buckets from 0 up and pair buckets from -1 down, or segments; ALL adds up a few numbers of each bucket.
ASK, COUNTS, PAIRS, LEAF, NEED, BASE, DOWN, UP, SEATS, STATE, TOTAL, SCALE, SUMS, OF_WORDS, OF_PAIRS, OF_SWEEPS = range(16)
ALL = (1 << 31) - 1


def _kept(rows: pa.Table, *kinds: int) -> pa.Table:
    return rows.filter(pa.array(np.isin(rows["kind"].to_numpy(), kinds))).cast(_ROW)


def _row(key: int, peer: int, kind: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"", x: list[float] | None = None) -> tuple:
    return key, peer, kind, a, b, c, d, x


def _of(rows: pa.Table, kind: int) -> list[dict]:
    """Rows of a kind by their peer, so that nothing hangs on the order of arrival."""
    return sorted(rows.filter(pa.array(rows["kind"].to_numpy() == kind)).to_pylist(), key=lambda r: r["peer"])


class Segment:
    """Tokens of a segment's documents: words (index into vocabulary), contexts (the start of a text: its length) and distinct pairs."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, learn: np.ndarray, ids: np.ndarray | None = None, nameless: np.ndarray | None = None):
        self.ids, self.nameless = ids, nameless
        words, lengths = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for first, last in pieces(offsets):
            w = Words(text, offsets, first, last, lower=True)
            n = len(w.start)
            tokens = np.full(n + w.n_docs, END, U64)
            tokens[np.arange(n) + w.doc] = w.hash
            words.append(tokens)
            lengths.append(np.diff(w.at) + 1)
        tokens, self.lengths = np.concatenate(words), np.concatenate(lengths)
        self.at = np.r_[0, np.cumsum(self.lengths)]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.learn = learn[self.doc]
        self.vocabulary, self.word = np.unique(tokens, return_inverse=True)

    @classmethod
    def unpacked(cls, rows: pa.Table) -> Segment:
        parts = []
        for blob in rows["docs"].to_pylist():
            raw = zstandard.decompress(blob)
            n = int.from_bytes(raw[:8], "little")
            parts.append((np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 8 + 16 * n), np.frombuffer(raw, np.uint8, -1, 8 + 17 * n)))
        ids, lengths, flags, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(text, np.r_[0, np.cumsum(lengths)], flags & 1 > 0, ids, flags & 2 > 0)

    def pair(self) -> None:
        v = len(self.vocabulary)
        context = np.r_[v, self.word[:-1]]
        context[self.at[:-1]] = v
        pairs, self.which = np.unique(context * (v + 1) + self.word, return_inverse=True)
        self.context, self.follower = pairs // (v + 1), pairs % (v + 1)
        self.count = np.bincount(self.which, self.learn, len(pairs)).astype(np.uint32)

    def deal(self, ids: np.ndarray, known: np.ndarray, buckets: int):
        """Order of the pairs of known words by bucket; their buckets, context ids (0: the start of a text) and word ids."""
        end = np.searchsorted(self.vocabulary, END)
        start = len(self.vocabulary)
        sent = np.flatnonzero(((self.context == start) | (np.r_[ids, 0][self.context] > 0)) & (ids[self.follower] > 0))
        ctx, word = np.r_[ids, 0][self.context[sent]], ids[self.follower[sent]]
        parts = 1 + np.r_[known, known[end]][self.context[sent]] // SALT
        bucket = X.bucket_of(mix(ctx.astype(U64) * U64(0x9E3779B97F4A7C15) + (word % parts).astype(U64)), buckets)
        by = np.argsort(bucket, kind="stable")
        return sent[by], bucket[by], ctx[by], word[by]


def _learned_words(batches, buckets: int):
    """Training counts of words, summed over about 64 MB of text before they are sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        h, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)
        yield from X.table(_ROW, [_row(b, -1, COUNTS, h[i:j].tobytes(), n[i:j].tobytes()) for b, i, j in X.dealt(h, buckets)]).to_batches()

    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            s = Segment(*flat(part["text"]), np.asarray(part["learn"]).astype(bool))
            n = np.bincount(s.word, s.learn, len(s.vocabulary)).astype(np.int64)
            held.append((s.vocabulary[n > 0], n[n > 0]))
            size += len(s.word)
        if size > 12_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _sum_words(rows: pa.Table) -> pa.Table:
    h = np.concatenate([np.frombuffer(x, U64) for x in rows["a"].to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["b"].to_pylist()])
    h, inverse = np.unique(h, return_inverse=True)
    n = np.bincount(inverse, n, len(h)).astype(np.int64)
    return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "a": [h.tobytes()], "b": [n.tobytes()], "types": [len(h)], "tokens": [int(n.sum())]})


def _packed(batches):
    """The documents of a batch for each segment, as one compressed row."""
    for batch in batches:
        batch = pa.Table.from_batches([batch]).sort_by("seg")
        text, offsets = flat(batch["text"])
        seg, learn = np.asarray(batch["seg"]), np.asarray(batch["learn"])
        flags = learn.astype(np.uint8) | np.asarray(batch["doc_id"].is_null()).astype(np.uint8) << 1
        ids = np.asarray(batch["doc_id"].fill_null(0)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else [0]
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            raw = (int(j - i).to_bytes(8, "little"), ids[i:j].tobytes(), np.diff(offsets[i : j + 1]).tobytes(), flags[i:j].tobytes(), text[offsets[i] : offsets[j]].tobytes())
            rows.append((int(seg[i]), zstandard.compress(b"".join(raw), 3)))
        yield from X.table(pa.schema([("seg", pa.int32()), ("docs", pa.binary())]), rows).to_batches()


def _ask(docs: pa.Table, buckets: int) -> pa.Table:
    s, seg = Segment.unpacked(docs), docs["seg"][0].as_py()
    return X.table(_ROW, [_row(b, seg, ASK, s.vocabulary[i:j].tobytes()) for b, i, j in X.dealt(s.vocabulary, buckets)])


def _numbers(asked: dict, h: np.ndarray, n: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For the words asked of a bucket of sorted hashes h: numbers (1 + place * buckets + bucket; 0: not in training) and training counts."""
    words = np.frombuffer(asked["a"], U64)
    if not len(h):
        return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(h, words), len(h) - 1)
    there = h[at] == words
    return np.where(there, 1 + at * buckets + asked["key"], 0), np.where(there, n[at], 0)


def _tell_numbers(asked: pa.Table, counts: pa.Table, buckets: int) -> pa.Table:
    own = _of(counts, COUNTS)
    h, n = (np.frombuffer(own[0][c], t) if own else np.zeros(0, t) for c, t in (("a", U64), ("b", np.int64)))
    return X.table(_ROW, [_row(r["peer"], r["key"], OF_WORDS, *map(X.packed, _numbers(r, h, n, buckets))) for r in _of(asked, ASK)])


def _joined(rows: list[dict], column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(X.unpacked(r[column]) for r in rows)])


def _send_pairs(docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    if not len(docs):
        return X.table(_ROW, [])
    s, seg, words = Segment.unpacked(docs), docs["seg"][0].as_py(), _of(told, OF_WORDS)
    s.pair()
    order, bucket, ctx, word = s.deal(_joined(words, "a"), _joined(words, "b"), buckets)
    rows = []
    for b, i, j in X.runs(bucket):
        first = np.flatnonzero(np.r_[True, ctx[i + 1 : j] != ctx[i : j - 1]])
        rows.append(_row(-1 - b, seg, PAIRS, X.packed(ctx[i:j][first]), X.packed(np.diff(np.r_[first, j - i])), X.packed(word[i:j]), X.packed(s.count[order[i:j]])))
    return X.table(_ROW, rows)


class Dishes:
    """A pair bucket's distinct pairs by context, then word: ctx, word, customers; which: each entry's pair; many: those of two customers or more."""

    def __init__(self, rows: list[dict]):
        ctx, word, count = np.repeat(_joined(rows, "a"), _joined(rows, "b")), _joined(rows, "c"), _joined(rows, "d")
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.ctx, self.word = c[new], w[new]
        self.customers = np.bincount(self.which, count, len(self.ctx)).astype(np.int64)
        self.many = np.flatnonzero(self.customers > 1)


def _home(number: np.ndarray, buckets: int) -> np.ndarray:
    """A number's word bucket; that of the start of a text is the first."""
    return np.where(number > 0, (number - 1) % buckets, 0)


def _listed(number: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers by bucket, each given number's place there, and the buckets of the distinct ones."""
    distinct, inverse = np.unique(number, return_inverse=True)
    home = _home(distinct, buckets)
    order = np.argsort(home, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[inverse], home[order]


def _by_home(*lists: tuple[np.ndarray, np.ndarray]):
    """For each bucket that any of the (values, sorted buckets) has: the bucket and its part of each."""
    for b in np.unique(np.concatenate([h for _, h in lists])).tolist():
        yield b, [v[np.searchsorted(h, b) : np.searchsorted(h, b, "right")] for v, h in lists]


def _settled(rows: pa.Table, words: int) -> pa.Table:
    """What a pair bucket's sweeps need: its dishes of many customers; whose chances it asks for; tables if each dish has one."""
    key = rows["key"][0].as_py()
    d = Dishes(_of(rows, PAIRS))
    ctx, at_ctx, home_ctx = _listed(d.ctx[d.many], words)
    word, at_word, home_word = _listed(d.word[d.many], words)
    out = [_row(key, -1, LEAF, X.packed(at_ctx), X.packed(at_word), X.packed(d.customers[d.many]), X.packed(np.array([len(ctx), len(word)])))]
    out += [_row(b, key, NEED, X.packed(w), X.packed(c)) for b, (w, c) in _by_home((word, home_word), (ctx, home_ctx))]
    seen = d.customers > 0
    word, at_word, home_word = _listed(d.word[seen], words)
    ctx, at_ctx, home_ctx = _listed(d.ctx[seen], words)
    for b, (w, n, c, m) in _by_home((word, home_word), (np.bincount(at_word, minlength=len(word)), home_word), (ctx, home_ctx), (np.bincount(at_ctx, minlength=len(ctx)), home_ctx)):
        out.append(_row(b, key, BASE, X.packed(w), X.packed(n), X.packed(c), X.packed(m)))
    return X.table(_ROW, out)


class Parents:
    """A word bucket's words: customers of the parent restaurant (tables of all contexts) and tables of the word's own restaurant.

    Slots are places of words; the last one is the start of texts.
    """

    def __init__(self, still: pa.Table, moved: pa.Table, words: int):
        self.needs = [(r["peer"], X.unpacked(r["a"]), X.unpacked(r["b"])) for r in _of(still, NEED)]
        base = [(X.unpacked(r["a"]), X.unpacked(r["b"]), X.unpacked(r["c"]), X.unpacked(r["d"])) for r in _of(still, BASE)]
        self.slots = 1 + max([int((w.max() - 1) // words + 1) for w, *_ in base if len(w)], default=0)
        self.words = words
        self.customers, self.tables = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64)
        more = {r["peer"]: (X.unpacked(r["a"]), X.unpacked(r["b"])) for r in _of(moved, UP)}
        for w, n, c, m in base:
            self.customers[self.slot(w)] += n
            self.tables[self.slot(c)] += m
        for peer, w, c in self.needs:
            if peer in more:
                self.customers[self.slot(w)] += more[peer][0]
                self.tables[self.slot(c)] += more[peer][1]

    def slot(self, number: np.ndarray) -> np.ndarray:
        return np.where(number > 0, (number - 1) // self.words, self.slots - 1)


def _in_words(sweep: int, burn: int, words: int, seed: int, still: pa.Table, moved: pa.Table) -> pa.Table:
    """Steps 1 and 2 of a sweep in a word bucket; other keys hand on what is kept. From the second sweep after burn on, states are kept."""
    if not len(still) or (key := still["key"][0].as_py()) < 0:
        return _kept(moved, SEATS, SUMS)
    p = Parents(still, moved, words)
    rng = np.random.default_rng([seed, 1, sweep, key])
    share = rng.standard_gamma(np.maximum(p.customers[:-1] - PARENT[0], 1e-12))  # scaled by the sum over all buckets where it is used
    latent = rng.standard_gamma(p.tables + CONTEXT[1] / CONTEXT[0])
    out = [_row(peer, key, DOWN, share[p.slot(w)].astype(np.float32).tobytes(), latent[p.slot(c)].astype(np.float32).tobytes()) for peer, w, c in p.needs]
    out.append(_row(ALL, key, TOTAL, x=[float(share.sum()), float(p.customers.sum()), float(p.tables[-1])]))
    if sweep > burn + 1:
        own = _of(moved, STATE)
        past = [(X.unpacked(r["a"]), X.unpacked(r["b"])) for r in own]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in past), now]) for k, now in ((0, p.customers), (1, p.tables)))
        out.append(_row(key, key, STATE, X.packed(a), X.packed(b)))
    return X.table(_ROW, out)


def _scale(sweep: int, burn: int, types: int, pairs: int, seed: int, rows: pa.Table) -> pa.Table:
    """The sum of all shares, the unseen one with them, for each pair bucket; after burn, the sums of each state kept."""
    if rows["key"][0].as_py() != ALL:
        return rows
    got = [r["x"] for r in _of(rows, TOTAL)]
    unseen = float(np.random.default_rng([seed, 3, sweep]).standard_gamma(PARENT[1] + PARENT[0] * types))
    share, customers, start = (float(sum(x[k] for x in got)) for k in range(3))
    out = [_row(-1 - b, -1, SCALE, x=[share + unseen]) for b in range(pairs)]
    if sweep > burn + 1:
        past = _of(rows, SUMS)
        out.append(_row(ALL, -1, SUMS, x=[*(past[0]["x"] if past else []), customers, start]))
    return X.table(_ROW, out)


def _in_pairs(sweep: int, burn: int, seed: int, still: pa.Table, moved: pa.Table) -> pa.Table:
    """Step 3 of a sweep in a pair bucket: tables of its dishes, and their sums beyond one for each. Other keys hand on what is kept."""
    if not len(still) or (key := still["key"][0].as_py()) >= 0:
        return _kept(moved, STATE, SUMS)
    leaf, downs = _of(still, LEAF)[0], _of(moved, DOWN)
    at_ctx, at_word, customers, (n_ctx, n_word) = (X.unpacked(leaf[c]) for c in "abcd")
    if not len(customers):
        return X.table(_ROW, [])
    share, latent = (np.concatenate([np.frombuffer(r[c], np.float32) for r in downs]).astype(float) for c in "ab")
    weight = CONTEXT[0] * latent[at_ctx] * share[at_word] / _of(moved, SCALE)[0]["x"][0]
    tables = seating.tables(customers, weight, CONTEXT[0], np.random.default_rng([seed, 2, sweep, -key]))
    of_word, of_ctx = np.bincount(at_word, tables - 1, n_word), np.bincount(at_ctx, tables - 1, n_ctx)
    out, w, c = [], 0, 0
    for r in downs:
        i, j = len(r["a"]) // 4, len(r["b"]) // 4
        out.append(_row(r["peer"], key, UP, X.packed(of_word[w : w + i]), X.packed(of_ctx[c : c + j])))
        w, c = w + i, c + j
    if sweep > burn:
        before = _of(moved, SEATS)
        out.append(_row(key, -1, SEATS, X.packed(tables + X.unpacked(before[0]["a"]) if before else tables)))
    return X.table(_ROW, out)


def _answer_words(asked: pa.Table, last: pa.Table, kept: int, buckets: int, segments: int) -> pa.Table:
    """For the words asked for: customers in the parent and tables of their own restaurant after each sweep kept; number and training count."""
    if sums := _of(last, SUMS):
        return X.table(_ROW, [_row(seg, -1, OF_SWEEPS, x=sums[0]["x"]) for seg in range(segments)])
    own, counts = _of(last, STATE), _of(last, COUNTS)
    state = [X.unpacked(own[0][c]).reshape(kept, -1) for c in "ab"] if own else [np.zeros((kept, 1), np.int64)] * 2
    h, n = (np.frombuffer(counts[0][c], t) if counts else np.zeros(0, t) for c, t in (("a", U64), ("b", np.int64)))
    out = []
    for r in _of(asked, ASK):
        number, count = _numbers(r, h, n, buckets)
        values = [np.where(number > 0, s[:, np.where(number > 0, (number - 1) // buckets, -1)], 0) for s in state]
        out.append(_row(r["peer"], r["key"], OF_WORDS, *(X.packed(v.ravel()) for v in values), X.packed(number), X.packed(count)))
    return X.table(_ROW, out)


def _answer_pairs(rows: pa.Table, last: pa.Table, kept: int) -> pa.Table:
    """For the pairs sent: customers, and tables summed over the sweeps kept."""
    sent = _of(rows, PAIRS)
    if not sent:
        return X.table(_ROW, [])
    d, seats = Dishes(sent), _of(last, SEATS)
    tables = np.where(d.customers > 0, kept, 0)
    if len(d.many):
        tables[d.many] = X.unpacked(seats[0]["a"])
    out, at = [], 0
    for r in sent:
        own = d.which[at : at + len(X.unpacked(r["c"]))]
        out.append(_row(r["peer"], r["key"], OF_PAIRS, X.packed(d.customers[own]), X.packed(tables[own])))
        at += len(own)
    return X.table(_ROW, out)


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("token_scores", pa.list_(pa.float64()))])


def _scored(docs: pa.Table, replies: pa.Table, kept: int, buckets: int, tokens: int, types: int, by_token: bool) -> pa.Table:
    if not len(docs):
        return X.table(_SCORES, [])
    s = Segment.unpacked(docs)
    s.pair()
    words, sums = _of(replies, OF_WORDS), _of(replies, OF_SWEEPS)
    ids, known = _joined(words, "c"), _joined(words, "d")
    order, bucket, *_ = s.deal(ids, known, buckets)
    parent, own = (np.concatenate([np.zeros((kept, 0), np.int64), *(X.unpacked(r[c]).reshape(kept, -1) for r in words)], axis=1) for c in "ab")
    totals = np.reshape(sums[0]["x"] if sums else np.zeros(2 * kept), (kept, 2))
    c, t = np.zeros(len(s.context)), np.zeros(len(s.context))
    got = {r["peer"]: r for r in _of(replies, OF_PAIRS)}
    for b, i, j in X.runs(bucket):
        c[order[i:j]], t[order[i:j]] = X.unpacked(got[-1 - b]["a"]), X.unpacked(got[-1 - b]["b"]) / kept
    end = np.searchsorted(s.vocabulary, END)
    customers = np.r_[known, known[end]].astype(float)[s.context]
    (d1, s1), (d0, s0) = CONTEXT, PARENT
    p = c - d1 * t
    for k, (total, start) in enumerate(totals):
        chance = np.where(ids > 0, parent[k] - d0, s0 + d0 * types) / (s0 + total)
        p += (s1 + d1 * np.r_[own[k], start][s.context]) * chance[s.follower] / kept
    p = np.log10(p / (s1 + customers))
    base = np.log10((known + 1) / (tokens + types + 1))
    n = len(s.lengths)
    each = pa.ListArray.from_arrays(pa.array(s.at, pa.int32()), pa.array(p[s.which])) if by_token else pa.nulls(n, pa.list_(pa.float64()))
    return pa.table([
        pa.array(s.ids, pa.int64(), mask=s.nameless), pa.array(s.lengths), pa.array(np.bincount(s.doc, known[s.word] > 0, n).astype(np.int64)),
        pa.array(np.bincount(s.doc, base[s.word], n)), pa.array(np.bincount(s.doc, p[s.which], n)), each,
    ], schema=_SCORES)


def score_texts(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn: int = BURN, seed: int = 20_240_607, by_token: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of each row of docs.

    Tokens are words (A-Z lowered) and one end for each text. held_out: a condition on doc_id; its rows
    are scored, not learned. n_known counts tokens seen in training; base_score is of single words with one added
    to each count. Perplexity is 10 ** (-score / n_tokens); by_token adds token_scores, each token's log10 probability.
    All words not seen in training are one unknown word, and after any context the chances of the known words and it
    add up to 1. Null and empty texts are one end; texts of any length are scored whole. With nothing to learn from, the
    unknown word has all. Rows of a null id are learned and scored as others. Repeated rows count each; an empty table gives
    an empty result; other columns are ignored, whatever their names. The same table gives the same scores, whatever its files.
    """
    if not 0 <= burn < sweeps:
        raise ValueError("some sweep must be averaged")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2 if held_out is None else held_out
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("learn", ~F.coalesce(held_out, F.lit(False)))
    size, kept = X.total_bytes(docs, "text"), sweeps - burn
    words, pairs, segments = max(4, size // (32 << 20)), max(4, size // 8 // BUCKET_ROWS), max(4, size // SEGMENT_BYTES)

    learned = docs.mapInArrow(lambda it: _learned_words(it, words), _DDL).withColumnRenamed("key", "bucket")
    learned = checkpointed(learned.groupBy("bucket").applyInArrow(_sum_words, "bucket int, a binary, b binary, types long, tokens long"))
    types, tokens = learned.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    counts = learned.select(F.col("bucket").alias("key"), F.lit(-1).alias("peer"), F.lit(COUNTS).alias("kind"), "a", "b", *[F.lit(b"").alias(c) for c in "cd"], F.lit(None).cast("array<double>").alias("x"))

    def in_words(sweep: int):
        return lambda s, m: _in_words(sweep, burn, words, seed, s, m)

    def scale(sweep: int):
        return lambda m: _scale(sweep, burn, types, pairs, seed, m)

    def in_pairs(sweep: int):
        return lambda s, m: _in_pairs(sweep, burn, seed, s, m)

    # from here on one query, whose exchanges (documents by segment, messages by bucket) are each written once and read again
    segs = docs.select(X.segment(segments, F.col("doc_id"), F.monotonically_increasing_id()), "doc_id", "text", "learn").mapInArrow(_packed, "seg int, docs binary")
    whole = segs.groupBy("seg")
    asked = whole.applyInArrow(lambda t: _ask(t, words), _DDL).groupBy("key")
    told = asked.cogroup(counts.groupBy("key")).applyInArrow(lambda a, c: _tell_numbers(a, c, words), _DDL)
    sent = whole.cogroup(told.groupBy("key")).applyInArrow(lambda d, r: _send_pairs(d, r, pairs), _DDL).groupBy("key")
    still = sent.applyInArrow(lambda t: _settled(t, words), _DDL).groupBy("key")
    moved = docs.sparkSession.createDataFrame([], _DDL)
    for sweep in range(1, sweeps + 2):  # the last only has the state after the sweep before
        moved = still.cogroup(moved.groupBy("key")).applyInArrow(in_words(sweep), _DDL)
        moved = moved.groupBy("key").applyInArrow(scale(sweep), _DDL)
        if sweep <= sweeps:
            moved = still.cogroup(moved.groupBy("key")).applyInArrow(in_pairs(sweep), _DDL)
    last = moved.unionByName(counts).groupBy("key")
    of_words = asked.cogroup(last).applyInArrow(lambda a, t: _answer_words(a, t, kept, words, segments), _DDL)
    of_pairs = sent.cogroup(last).applyInArrow(lambda s, t: _answer_pairs(s, t, kept), _DDL)
    replies = of_words.unionByName(of_pairs).groupBy("key")
    scored = whole.cogroup(replies).applyInArrow(lambda d, r: _scored(d, r, kept, pairs, tokens, types, by_token), "doc_id long, n_tokens long, n_known long, base_score double, score double, token_scores array<double>")
    more = ["token_scores"] if by_token else []
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", *more)
