"""Words of whole Arrow text columns as numpy arrays, without a Python object for each word.

A word is a maximal run of bytes other than ASCII white space (space and \\t to
\\r). Work goes piece by piece (``PIECE`` bytes, whole documents), so a batch of
any size takes bounded memory beside its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, U64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal content wherever it stands."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(values))[starts])


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, U64)
    starts = np.arange(len(h) - n + 1)
    return span_hashes(h, starts, starts + n)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) one after another, and the len + 1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, width)
    at = at.astype(np.int64)
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return text, at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """(first, last) document ranges of about size bytes; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of documents first..last of a flat text.

    data: the bytes (lower: A-Z lowered); start, end: byte spans; doc: index of
    the document, from first; hash: 64-bit; at: len(docs) + 1 offsets into words.
    """

    def __init__(self, text: np.ndarray, offsets: np.ndarray, first: int, last: int, lower: bool = False):
        self.n_docs = last - first
        self.bounds = offsets[first : last + 1] - offsets[first]
        data = text[offsets[first] : offsets[last]]
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.bounds] = True
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.at))
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(_BYTE[self.data], self.start, self.end)
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each n words in a row of one document."""
        h = run_hashes(self.hash, n)
        first = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
        return first, h[first]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each \\n-split line that holds a word."""
        cut = np.union1d(np.flatnonzero(self.data == 10) + 1, self.bounds)
        starts, ends = cut[:-1], cut[1:].copy()
        ends -= (ends > starts) & (self.data[ends - 1] == 10)
        has = np.searchsorted(self.start, ends) > np.searchsorted(self.start, starts)
        starts, ends = starts[has], ends[has]
        return np.searchsorted(self.bounds, starts, "right") - 1, span_hashes(_BYTE[self.data], starts, ends)


def repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in document order: is it equal to an earlier one of its document; has it an equal there."""
    key = h ^ mix(doc.astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    earlier, shared = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order] = same
    shared[order] = same | np.r_[same[1:], False]
    return earlier, shared


def counts(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
