"""Tokens of two tokenizers aligned over the same bytes.

Each text is encoded twice, and every token covers a range of the text's bytes. The tokens of both sides are sorted
by where they start; the running maximum of their ends breaks them into groups wherever a start reaches it, and
within a group the tokens that overlap are paired. All of it is numpy over many texts at once.

A text is cut before a space that follows a character other than white space. No token of either side
crosses such a place, so the parts are encoded and aligned alone: each distinct part once, and the texts gather them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written
from .exchange import packed, unpacked
from .words import flat, pieces

#: Distinct parts and their bytes that a task remembers; it then starts anew.
REMEMBERED, REMEMBERED_BYTES = 250_000, 16 << 20
#: Bytes of text aligned at once, whole documents.
PIECE = 1 << 20
MARK = "▁"
#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LIST = pa.list_(pa.int32())
SCHEMA = pa.schema([("doc_id", pa.int64()), ("a_ids", _LIST), ("b_ids", _LIST), ("a_cuts", _LIST), ("b_cuts", _LIST), ("link_a", _LIST), ("link_b", _LIST)])
DDL = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, link_a array<int>, link_b array<int>"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Pair:
    """Paths of a byte-level vocabulary (A) and of a model of pieces (B), and which pairs are links: ``ends`` or ``overlaps``."""

    a_path: str
    b_path: str
    links: str = "ends"


class Flat:
    """Lists one after another, in a buffer that doubles."""

    def __init__(self):
        self.n, self.buffer, self.ends = 0, np.zeros(1 << 12, np.int32), [np.zeros(1, np.int64)]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(values) > len(self.buffer):
            self.buffer = np.concatenate([self.buffer, np.zeros_like(self.buffer)])
        self.buffer[self.n : self.n + len(values)] = values
        self.ends.append(self.n + np.cumsum(sizes))
        self.n += len(values)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after another, and their sizes."""
        at = np.concatenate(self.ends)
        self.ends = [at]
        n = at[which + 1] - at[which]
        return self.buffer[spread(at[which], n)], n


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + n[0] - 1, then those of starts[1], .."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number of each interval, rising with its start: a group ends where a start reaches all earlier ends."""
    if len(start) == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.r_[0, np.cumsum(start[order][1:] >= reach[:-1])]
    return group


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all overlapping intervals of two sides, each in order and without overlaps of its own."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    return np.repeat(np.arange(len(a_start)), n), spread(first, n)


class Tokens:
    """Bytes of each id of a vocabulary."""

    def __init__(self, texts: list[bytes]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.at[ids], self.size[ids])]


def merge_ranks(path: str) -> tuple[dict[bytes, int], str]:
    """Bytes and rank of each token of a byte-level vocabulary, and the pattern that splits texts before merging.

    Ranks are ids, so the vocabulary must number its merges in their order; it must split by the known pattern and not change the text.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told.get("pre_tokenizer") or {}, told["model"]
    if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space", True) or told.get("normalizer"):
        raise ValueError("side A needs a byte-level vocabulary that splits by the usual pattern and changes no text")
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if model["type"] != "BPE" or [model["vocab"][j] for j in joined] != list(range(256, 256 + len(joined))):
        raise ValueError("side A needs merges numbered in their order")
    letters, own = byte_letters(), {t["content"] for t in told.get("added_tokens", ())}
    return {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in own}, PATTERN


class Aligner:
    def __init__(self, pair: Pair):
        import sentencepiece
        import tiktoken

        self.links = pair.links
        ranks, pattern = merge_ranks(pair.a_path)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        words = {i: t for t, i in ranks.items()}
        self.a_tokens = Tokens([words.get(i, b"") for i in range(max(words) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.b_path)
        ids = range(self.b.get_piece_size())
        spelled = [self.b.id_to_piece(i) for i in ids]
        self.b_tokens = Tokens([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in zip(ids, spelled, strict=True)])
        self.space = self.b.piece_to_id(MARK)
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in spelled)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.exact = np.zeros(0, bool)
        self.a_ids, self.b_ids, self.a_cuts, self.b_cuts, self.link_a, self.link_b = (Flat() for _ in range(6))

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where parts begin, and the end of all."""
        begins = np.zeros(len(data), bool)
        if self.cuttable and len(data) > 1:
            before = data[:-1]
            solid = (before > 32) & (before < 127)
            # the second byte of U+00C0 .. U+07FF; none of these is white space
            solid[1:] |= (before[1:] > 127) & (before[:-1] >= 0xC3) & (before[:-1] < 0xE0)
            begins[1:] = (data[1:] == 32) & solid
        begins[at[:-1][at[:-1] < at[1:]]] = True
        return np.r_[np.flatnonzero(begins), len(data)].astype(np.int64)

    def encode_a(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A ids of all parts, and how many each has. Parts in a row are one text to the encoder as long as each may be cut off there."""
        loose = [not self.cuttable or t[-1].isspace() for t in texts]
        bounds = [0, *(k + 1 for k, x in enumerate(loose[:-1]) if x), len(texts)] if texts else [0]
        ids = np.concatenate([np.zeros(0, np.uint32), *(self.a.encode_to_numpy("".join(texts[i:j]), disallowed_special=()) for i, j in zip(bounds, bounds[1:]))]).astype(np.int32)
        ends = np.searchsorted(np.cumsum(self.a_tokens.size[ids]), np.cumsum(size)) + 1
        return ids, np.diff(ends, prepend=0)

    def solve(self, parts: list[bytes]) -> None:
        """Encodes and aligns new parts; each begins with a space."""
        self.known |= {p: len(self.exact) + k for k, p in enumerate(parts)}
        self.known_bytes += sum(map(len, parts))
        texts = [p.decode() for p in parts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        a_ids, a_count = self.encode_a(texts, size)
        listed = self.b.encode([t[1:] for t in texts], num_threads=1)
        listed = [i if len(t) > 1 else [self.space] for t, i in zip(texts, listed, strict=True)]
        b_count = np.fromiter(map(len, listed), np.int64, len(listed))
        b_ids = np.fromiter(chain.from_iterable(listed), np.int32, int(b_count.sum()))
        sides, exact = [], np.ones(len(parts), bool)
        for ids, n, tokens in ((a_ids, a_count, self.a_tokens), (b_ids, b_count, self.b_tokens)):
            own = np.repeat(np.arange(len(parts)), n)
            exact &= np.bincount(own, tokens.size[ids], len(parts)).astype(np.int64) == size
            sides.append([ids, own, tokens])
        for ids, own, tokens in sides:
            keep = exact[own]
            wrong = tokens.bytes_of(ids[keep]) != data[np.repeat(exact, size)]
            at = np.repeat(np.flatnonzero(exact), size[exact])
            exact[at[wrong]] = False
        spans = []
        for side in sides:
            ids, own, tokens = side
            keep = exact[own]
            side[:2] = ids[keep], own[keep]
            end = np.cumsum(tokens.size[ids[keep]])
            spans.append((end - tokens.size[ids[keep]], end))
        (a_ids, a_own, _), (b_ids, b_own, _) = sides
        (a_start, a_end), (b_start, b_end) = spans
        group = coalesce(np.r_[a_start, b_start], np.r_[a_end, b_end])
        for ids, own, g, store, cut in ((a_ids, a_own, group[: len(a_ids)], self.a_ids, self.a_cuts), (b_ids, b_own, group[len(a_ids) :], self.b_ids, self.b_cuts)):
            n = np.bincount(own, minlength=len(parts))
            first = np.cumsum(n) - n
            store.add(ids, n)
            last = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) if len(g) else np.zeros(0, np.int64)
            cut.add(last + 1 - first[own[last]], np.bincount(own[last], minlength=len(parts)))
            if cut is self.a_cuts:
                a_first = first
            else:
                b_first = first
        i, j = overlaps(a_start, a_end, b_start, b_end)
        if self.links == "ends":
            together = a_end[i] == b_end[j]
            i, j = i[together], j[together]
        n = np.bincount(a_own[i], minlength=len(parts))
        self.link_a.add(i - a_first[a_own[i]], n)
        self.link_b.add(j - b_first[b_own[j]], n)
        self.exact = np.r_[self.exact, exact]

    def align(self, texts: pa.Array) -> list[pa.Array]:
        """The lists of SCHEMA for each text."""
        texts = texts.fill_null("")
        raw, offsets = flat(texts)
        # one space before each text that is not empty
        n = np.diff(offsets)
        led = n + (n > 0)
        at = np.r_[0, np.cumsum(led)]
        data = np.full(at[-1], 32, np.uint8)
        data[spread(at[:-1] + 1, n)] = raw
        cuts = self.cuts(data, at)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:
            self.forget()
            new = distinct
        if new:
            self.solve(new)
        number = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))
        which = number[parts.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        first = np.searchsorted(cuts[:-1], at)
        own = np.repeat(np.arange(len(n)), np.diff(first))
        fine = np.ones(len(n), bool)
        fine[own[~self.exact[which]]] = False
        which, own = which[fine[own]], own[fine[own]]
        out, base = [], {}
        for name, lists in (("a", self.a_ids), ("b", self.b_ids), ("a", self.a_cuts), ("b", self.b_cuts), ("a", self.link_a), ("b", self.link_b)):
            values, sizes = lists.take(which)
            if name not in base:
                before = np.cumsum(sizes) - sizes
                head = np.searchsorted(own, np.arange(len(n)))
                base[name] = before - np.r_[before, 0][head][own]
            else:  # numbers of tokens in a part become those in the text
                values = values + np.repeat(base[name], sizes)
            total = np.bincount(own, sizes, len(n)).astype(np.int64)
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total)], pa.int32()), pa.array(values, pa.int32())))
        return out


_aligners: dict[Pair, Aligner] = {}


def aligner(pair: Pair) -> Aligner:
    """The task process's aligner, built once."""
    if pair not in _aligners:
        _aligners.clear()
        _aligners[pair] = Aligner(pair)
    return _aligners[pair]


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", then: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, ddl: str = DDL) -> DataFrame:
    """The tokens of both sides for each row, their groups and the linked pairs.

    ``then`` makes rows of ``ddl`` of the batches of rows before they leave the task, so that lists nobody asks for go nowhere.

    doc_id; a_ids, b_ids: ids of the space and the text (B adds the space itself); a_cuts, b_cuts: how many tokens of
    each side lie before the end of each group; link_a, link_b: numbers, from 0, of the two tokens of each link. A
    group ends where tokens of both sides end. A link is a pair of tokens that overlap or, of these, that end together.

    Null and empty texts, and texts whose tokens do not spell them (such as texts that hold the space mark), have no
    tokens: all lists are empty. Repeated rows are each aligned; null ids stay null. Texts of any length are taken
    whole; a run without a place to cut is encoded in one piece. Strings of special tokens are plain text. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    if pair.links not in ("ends", "overlaps"):
        raise ValueError("links are 'ends' or 'overlaps'")

    def aligned(batches):
        own = aligner(pair)
        for batch in batches:
            for first, last in pieces(flat(batch["text"])[1], PIECE):
                part = batch.slice(first, last - first)
                yield pa.record_batch([part["doc_id"], *own.align(part["text"])], schema=SCHEMA)
        own.forget()  # the process may serve other tasks next

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(aligned if then is None else lambda b: then(aligned(b)), ddl)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and its offsets from 0."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), at - at[0]


def absolute(values: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Numbers within each row's list as numbers within all lists of the batch."""
    return values + np.repeat(base[:-1], np.diff(at))


def linked_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A id and B id of each link, and the rows' offsets."""
    a, a_at = lists(batch["a_ids"])
    b, b_at = lists(batch["b_ids"])
    i, at = lists(batch["link_a"])
    j, _ = lists(batch["link_b"])
    return a[absolute(i, at, a_at)], b[absolute(j, at, b_at)], at


class Writer:
    """Groups as text: ids joined by commas, the sides by a bar, groups by semicolons."""

    def __init__(self):
        self.words: dict[str, np.ndarray] = {}

    def spelled(self, ids: np.ndarray, ends: np.ndarray, sep: str) -> np.ndarray:
        """Each id with what follows it: sep if it ends its group's side, else a comma."""
        most = int(ids.max(initial=0)) + 1
        for s in (",", sep):
            if len(self.words.get(s, ())) < most:
                self.words[s] = np.array([f"{i}{s}" for i in range(max(most, 1 << 16))], object)
        out = self.words[","][ids]
        out[ends] = self.words[sep][ids[ends]]
        return out

    def __call__(self, batch: pa.RecordBatch) -> list[str]:
        a, a_at = lists(batch["a_ids"])
        b, b_at = lists(batch["b_ids"])
        a_cut, at = lists(batch["a_cuts"])
        b_cut, _ = lists(batch["b_cuts"])
        a_cut, b_cut = absolute(a_cut, at, a_at), absolute(b_cut, at, b_at)
        out = np.empty(len(a) + len(b), object)
        # the tokens of the other side that stand before each one
        out[np.arange(len(a)) + np.repeat(np.r_[0, b_cut[:-1]], np.diff(a_cut, prepend=0))] = self.spelled(a, a_cut - 1, "|")
        out[np.arange(len(b)) + np.repeat(a_cut, np.diff(b_cut, prepend=0))] = self.spelled(b, b_cut - 1, ";")
        ends = (a_at + b_at).tolist()
        return ["".join(out[i:j])[:-1] for i, j in zip(ends, ends[1:])]


_LONG = pa.int64()
_ROWS = pa.schema([("doc_id", _LONG), ("n_a", _LONG), ("n_b", _LONG), ("n_groups", _LONG), ("n_links", _LONG), ("groups_sha256", pa.string()), ("link_a", pa.binary()), ("link_b", pa.binary())])
_ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_a binary, link_b binary"
_COUNTS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", _LONG)])
_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Pairs that a task counts before it sends them on, and links that it looks at at once.
COUNTED, LINKS = 1 << 20, 1 << 18
_ID_BITS = 32


def _digests(batches):
    write = Writer()
    for batch in batches:
        a, b, at = linked_ids(batch)
        ends = at.tolist()
        links = [pa.array([packed(x[i:j]) for i, j in zip(ends, ends[1:])], pa.binary()) for x in (a, b)]
        sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in write(batch)]
        n = [pa.array(np.diff(lists(batch[c])[1]), _LONG) for c in ("a_ids", "b_ids", "a_cuts", "link_a")]
        yield pa.record_batch([batch["doc_id"], *n, pa.array(sha, pa.string()), *links], schema=_ROWS)


def _few(batches):
    """The batches in slices of some LINKS links, whole rows."""
    for batch in batches:
        n = np.r_[0, np.cumsum(batch["n_links"].to_numpy())]
        for first, last in pieces(n, LINKS):
            yield batch.slice(first, last - first)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of all rows, and how many each row has."""
    a, b = ([unpacked(x) for x in batch[c].to_pylist()] for c in ("link_a", "link_b"))
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *a]) << _ID_BITS) | np.concatenate([none, *b]), np.fromiter(map(len, a), np.int64, len(a))


def _counted(batches):
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told():
        return pa.record_batch([pa.array((code >> _ID_BITS).astype(np.int32)), pa.array((code & ((1 << _ID_BITS) - 1)).astype(np.int32)), pa.array(n)], schema=_COUNTS)

    for batch in _few(batches):
        more, m = np.unique(_codes(batch)[0], return_counts=True)
        code, inverse = np.unique(np.r_[code, more], return_inverse=True)
        n = np.bincount(inverse, np.r_[n, m], len(code)).astype(np.int64)
        if len(code) > COUNTED:
            yield told()
            code, n = code[:0], n[:0]
    yield told()


def link_report(docs: DataFrame, pair: Pair, **columns: str) -> DataFrame:
    """Sizes of each row of align(docs, pair), with how common its links are in all rows; links are those that end together.

    A pair of ids counts as many times as a link joins it in any row. n_best: the row's links whose count is the highest of
    their B id, ties included; count_sum: the sum of the counts. groups_sha256: digest of the groups
    as text (Writer), empty for a row without tokens. An empty table gives an empty result.

    The rows are kept in the shared folder with their links packed, so that nothing is encoded twice. Of the links that end together
    one token's bytes are the end of the other's, so there are no more pairs of ids than bytes in the two
    vocabularies: their counts (some 20 bytes each, under 15 MB) are sent with the tasks whatever the corpus.
    Links by overlap have no such bound and are not reported here.
    """
    if pair.links != "ends":
        raise ValueError("only links that end together are counted")
    spark = docs.sparkSession
    rows = written(align(docs, pair, then=_digests, ddl=_ROWS_DDL, **columns), "aligned")
    counts = rows.select("n_links", "link_a", "link_b").mapInArrow(_counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    code = (counts["a"].to_numpy().astype(np.int64) << _ID_BITS) | counts["b"].to_numpy()
    order = np.argsort(code)
    code, n, b = code[order], counts["n"].to_numpy()[order], counts["b"].to_numpy()[order]
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, n)
    sent = spark.sparkContext.broadcast((code, n, n == most[b]))

    def judged(batches):
        known, n, best = sent.value
        for batch in _few(batches):
            code, size = _codes(batch)
            at = np.searchsorted(known, code)
            own = np.repeat(np.arange(len(size)), size)
            total, top = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, own, n[at])
            np.add.at(top, own, best[at].astype(np.int64))
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(top), pa.array(total), batch["groups_sha256"]], names=[c.split()[0] for c in _REPORT.split(", ")])

    return rows.mapInArrow(judged, _REPORT)
