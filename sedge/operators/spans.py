"""Tokens of several tokenizers over the same text: which token covers each character, and where they differ."""

from __future__ import annotations

import heapq
import itertools
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.subwords import PIECE, runs_of

_MARKS = ("##", "▁")
TYPES, WEIGHTS = ("merge_difference", "split_difference", "unknown_handling"), ("high", "medium", "low")
DIFFERENCES = "array<struct<position:int,type:string,significance:string,models:map<string,array<string>>>>"
_DIFFERENCES = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("significance", pa.string()), ("models", pa.map_(pa.string(), pa.list_(pa.string())))]))
SPANS = "array<struct<token:string,start:int,end:int>>"


def tokens_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern that leaves nothing between matches."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _read(value) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens and their spans; tokens without spans follow one another from the start of the text."""
    items = [] if value is None else list(value)
    if not items or not isinstance(items[0], str):
        return [x["token"] for x in items], [(x["start"], x["end"]) for x in items]
    ends = list(itertools.accumulate(map(len, items)))
    return items, list(zip([0, *ends], ends))


def covering(spans: list[tuple[int, int]], length: int) -> list[int]:
    """Number of the first span that covers each position, -1 for none: one sweep over starts, ends carried along.

    Spans may overlap and lie in any order; of those that cover a position the one with the smallest number counts.
    """
    out = [-1] * length
    order = sorted((max(0, a), k) for k, (a, b) in enumerate(spans) if b > a and b > 0 and a < length)
    open_: list[int] = []
    at = 0
    for i, (start, k) in enumerate(order):
        heapq.heappush(open_, k)
        stop = order[i + 1][0] if i + 1 < len(order) else length
        at = start
        while at < stop:
            while open_ and spans[open_[0]][1] <= at:
                heapq.heappop(open_)
            if not open_:
                break
            until = min(stop, spans[open_[0]][1])
            out[at:until] = [open_[0]] * (until - at)
            at = until
    return out


class _Piece:
    """Rows of texts with the tokens of all tokenizers as numbers: what covers each character of the piece, and the places where tokens differ.

    lengths: characters of each text; columns: for each tokenizer an array of lists of SPANS' structs or of tokens.
    """

    def __init__(self, lengths: np.ndarray, columns: list[pa.Array]):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        rows, tokens, spans = [], [], []
        for c in columns:
            sizes = pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64)
            flat = c.flatten()
            own = pa.types.is_struct(flat.type)
            rows.append(np.concatenate([[0], np.cumsum(sizes)]))
            spans.append([pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False) for k in ("start", "end")] if own else None)
            tokens.append((pc.struct_field(flat, ["token"]) if own else flat).cast(pa.large_string()))
        coded = pa.concat_arrays(tokens).dictionary_encode()
        self.values = coded.dictionary
        codes = np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in tokens])[:-1])
        size = pc.utf8_length(self.values).to_numpy().astype(np.int32)
        self.rows, self.codes, self.tokens = rows, codes, tokens
        self.cover = [self._cover(r, s, size[c], lengths) for r, s, c in zip(rows, spans, codes)]
        self._find(size)

    def _cover(self, rows: np.ndarray, spans: list | None, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of the token that covers each character, -1 for none."""
        upto = np.concatenate([[0], np.cumsum(size)])
        if spans is None and (np.diff(upto[rows]) == lengths).all():
            return np.repeat(np.arange(len(size), dtype=np.int32), size)
        out = [np.zeros(0, np.int32)]
        for first, last, n in zip(rows[:-1], rows[1:], lengths):
            own = zip(upto[first:last] - upto[first], upto[first + 1 : last + 1] - upto[first]) if spans is None else zip(*(s[first:last] for s in spans))
            got = np.array(covering([(int(a), int(b)) for a, b in own], int(n)), np.int32)
            out.append(np.where(got >= 0, got + first, -1).astype(np.int32))
        return np.concatenate(out)

    def _find(self, size: np.ndarray) -> None:
        """Places where tokens differ, each text from the left; after one, as many positions as its longest token has characters are passed over.
        Positions that fewer than two tokenizers cover are nothing."""
        length = len(self.cover[0])
        kinds, covered, longest, seen = np.zeros(length, np.int8), np.zeros(length, np.int8), np.ones(length, np.int32), []
        for cover, codes in zip(self.cover, self.codes):
            own = np.append(codes, np.int32(-1))[cover]  # -1 is the last one
            there = own >= 0
            new = there.copy()
            for other in seen:
                new &= own != other
            kinds += new
            covered += there
            np.maximum(longest, np.append(size, np.int32(0))[own], out=longest)
            seen.append(own)
        differ = (covered > 1) & (kinds > 1)
        before = np.concatenate([[0], np.cumsum(differ)])
        found = np.flatnonzero(differ)
        row = np.searchsorted(self.starts, found, "right") - 1  # texts of no length before it are passed over
        following, k, taken = array("q", before[np.minimum(found + longest[found], self.ends[row])].tobytes()), 0, array("q")
        while k < len(following):
            taken.append(k)
            k = following[k]
        self.at, self.row = found[taken], row[taken]
        self.covered, self.kinds, self.own = covered[self.at], kinds[self.at], [s[self.at] for s in seen]

    def place(self) -> np.ndarray:
        return self.at - self.starts[self.row]

    def types(self) -> np.ndarray:
        """Number in TYPES of each place: unknown if a token is a mark of the unknown, merge if the longest is more than 1.5 times the shortest and over 2 characters, else split."""
        marks = pc.or_(pc.match_substring(self.values, "[UNK"), pc.match_substring(self.values, "[0x")).to_numpy(zero_copy_only=False).astype(bool)
        size = pc.utf8_length(self.values).to_numpy() - sum(pc.starts_with(self.values, m).to_numpy(zero_copy_only=False).astype(np.int64) * len(m) for m in _MARKS)
        n = len(self.at)
        low, high, unknown = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, bool)
        for own in self.own:
            there = own >= 0
            of = np.append(size, 0)[own]
            low, high = np.where(there, np.minimum(low, of), low), np.maximum(high, of)
            unknown |= np.append(marks, False)[own]
        return np.where(unknown, 2, np.where((high > low * 1.5) & (high > 2), 0, 1))

    def significance(self) -> np.ndarray:
        """Number in WEIGHTS of each place by the share of distinct tokens among the tokenizers there: over 0.7 high, over 0.4 medium, else low."""
        share = self.kinds / self.covered
        return np.where(share > 0.7, 0, np.where(share > 0.4, 1, 2))

    def around(self, model: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end among a tokenizer's tokens of the one at each place with its neighbours; equal where it has none."""
        at, rows = self.cover[model][self.at], self.rows[model]
        first = np.maximum(rows[self.row], at - 1)
        return first, np.where(at >= 0, np.minimum(rows[self.row + 1], at + 2), first)

    def alike(self) -> list[np.ndarray]:
        """For each tokenizer and place: whether it covers the place and more than half of all have the same characters in the tokens around it."""
        sides = []
        for m, tokens in enumerate(self.tokens):
            offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
            data = (tokens.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(tokens) else b""
            first, last = (offsets[x] for x in self.around(m))
            sides.append((self.own[m] >= 0, first, last, offsets[self.rows[m]], data))
        same = [there.astype(np.int64) for there, *_ in sides]
        for m, (there, a, b, texts, data) in enumerate(sides):
            for k in range(m):
                other, c, d, others, more = sides[k]
                equal = there & other & (b - a == d - c)
                whole = np.fromiter((data[texts[i] : texts[i + 1]] == more[others[i] : others[i + 1]] for i in range(len(texts) - 1)), bool, len(texts) - 1)
                here = whole[self.row] & (a - texts[self.row] == c - others[self.row])  # the same characters of the same text
                for i in np.flatnonzero(equal & ~here).tolist():
                    equal[i] = data[a[i] : b[i]] == more[c[i] : d[i]]
                same[m] += equal
                same[k] += equal
        return [x[0] & (s > len(sides) / 2) for x, s in zip(sides, same)]

    def consistency(self) -> list[np.ndarray]:
        """For each tokenizer and text: the share of the places it takes part in where it is alike (1 without any)."""
        out = []
        for own, like in zip(self.own, self.alike()):
            takes, same = (np.bincount(self.row[x], minlength=len(self.starts)) for x in (own >= 0, like))
            out.append(np.where(takes > 0, same / np.maximum(takes, 1), 1.0))
        return out


def character_alignment(texts: DataFrame, models: dict[str, str], id_col: str, text_col: str = "text") -> DataFrame:
    """The id, position, character and, for each tokenizer (models: name to its column, an array of SPANS' structs or of tokens that make up the text), token_<name>: the token that covers the character.

    A row a character; null where no token covers it. Spans are swept once for each text, so nothing is joined by range. Null texts have no rows.
    """
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                text, row = batch["text"].iloc[k], batch.iloc[k]
                if not text:
                    continue
                out = {id_col: row["id"], "position": range(len(text)), "character": list(text)}
                for name in models:
                    tokens, spans = _read(row[f"s_{name}"])
                    out[f"token_{name}"] = [tokens[c] if c >= 0 else None for c in covering(spans, len(text))]
                yield pd.DataFrame(out)

    thin = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"s_{n}") for n, c in models.items()))
    return thin.mapInPandas(run, f"`{id_col}` {kind}, position int, character string, " + ", ".join(f"token_{n} string" for n in models))


def _by_piece(texts: DataFrame, models: dict[str, str], id_col: str, text_col: str, ddl: str, of: Callable[[_Piece], list[pa.Array]]) -> DataFrame:
    """The id and what a function makes of each piece of texts, as ``ddl``."""
    kind = texts.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in ddl.split(", "))]

    def run(batches):
        for batch in batches:
            ids, lengths, columns = batch.column("id"), batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64), [batch.column(f"s_{n}") for n in models]
            for first, last in runs_of(lengths.tolist(), PIECE):  # what is known of each character is many times the texts
                n = last - first
                got = of(_Piece(lengths[first:last], [c.slice(first, n) for c in columns]))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), *got], names=names)

    thin = texts.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("length"), *(F.col(c).alias(f"s_{n}") for n, c in models.items()))
    return thin.mapInArrow(run, f"`{id_col}` {kind}, {ddl}")


def _shares(models: dict[str, str], piece: _Piece) -> pa.Array:
    return pa.array([list(zip(models, x)) for x in zip(*(c.tolist() for c in piece.consistency()))], pa.map_(pa.string(), pa.float64()))


def tokenizer_differences(texts: DataFrame, models: dict[str, str], id_col: str, text_col: str = "text") -> DataFrame:
    """The id, differences (DIFFERENCES, from the left: position, type, significance and the tokens around it of each tokenizer) and consistency: for each tokenizer the share
    of the differences it takes part in where more than half of all tokenizers have the same tokens around the place as it has (1 without any)."""

    def of(piece: _Piece) -> list[pa.Array]:
        rows: list[list] = [[] for _ in piece.starts]
        around = [[x.tolist() for x in piece.around(m)] for m in range(len(models))]
        listed = [x.to_pylist() for x in piece.tokens]
        for k, (row, at, kind, weight) in enumerate(zip(*(x.tolist() for x in (piece.row, piece.place(), piece.types(), piece.significance())))):
            own = [(n, said[a[k] : b[k]]) for n, said, (a, b), there in zip(models, listed, around, piece.own) if there[k] >= 0]
            rows[row].append({"position": at, "type": TYPES[kind], "significance": WEIGHTS[weight], "models": own})
        return [pa.array(rows, _DIFFERENCES), _shares(models, piece)]

    return _by_piece(texts, models, id_col, text_col, f"differences {DIFFERENCES}, consistency map<string,double>", of)


def difference_counts(texts: DataFrame, models: dict[str, str], id_col: str, text_col: str = "text") -> DataFrame:
    """Of tokenizer_differences(): the id, numbers of differences, of each type and of those of high significance, the last position, and consistency."""

    def of(piece: _Piece) -> list[pa.Array]:
        def count(which=slice(None)) -> pa.Array:
            return pa.array(np.bincount(piece.row[which], minlength=len(piece.starts)), pa.int64())

        types, upto = piece.types(), np.searchsorted(piece.row, np.arange(len(piece.starts)), "right")
        none = np.bincount(piece.row, minlength=len(piece.starts)) == 0
        last = pa.array(np.append(piece.place(), 0)[upto - 1], pa.int32(), mask=none)
        return [count(), *(count(types == k) for k in range(len(TYPES))), count(piece.significance() == 0), last, _shares(models, piece)]

    return _by_piece(texts, models, id_col, text_col, "differences long, merge long, split long, unknown long, high long, last int, consistency map<string,double>", of)
