"""SentencePiece text to ids and back.

An Aho-Corasick automaton over all pieces reports, at each end position, every piece that ends
there (its own and those along output links); a single pass relaxes the best score of each position.
Text is cut before each run of the space mark, which no piece crosses, so cuts change no result:
a batch's parts are told apart by Arrow, each distinct one is solved once, and ids are gathered by offsets.
Characters that no piece has go to byte pieces.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import flat, pieces

MARK = "▁"
#: Parts that a task remembers with their ids before it starts a new generation; the one before stays.
REMEMBERED = 100_000
_LOW = float("-inf")


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with scores, ids of the 256 byte pieces. Bounded by the model, so it is sent with the tasks."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        bytes_ = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        plain = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        if any(MARK in p.lstrip(MARK) for p, _, _ in plain) or len(set(bytes_)) != 256:
            raise ValueError("the model needs byte pieces and none that crosses a space")
        return cls(plain, bytes_)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids = vocabulary.byte_ids
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.length = {i: len(p) for p, i, _ in vocabulary.pieces}
        self.text = {i: p.replace(MARK, " ").encode() for p, i, _ in vocabulary.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        #: A byte costs more than any piece.
        self.byte_cost = min(s for _, _, s in vocabulary.pieces) - 10.0
        self.fresh: dict[bytes, tuple[list[int], bool]] = {}
        self.older: dict[bytes, tuple[list[int], bool]] = {}

    def best(self, part: str) -> list[int]:
        """Ids of the highest sum of scores; of equals, the one whose last pieces are longer."""
        n, cost = len(part), self.byte_cost
        short = n < 256
        score = [_LOW] * (n + 1) if short else array("d", [_LOW]) * (n + 1)
        piece = [-1] * (n + 1) if short else array("i", [-1]) * (n + 1)
        score[0] = 0.0
        done = 0  # positions up to here are final
        for end, (length, i, s) in self.automaton.iter(part):
            while done < end:  # bytes may reach what no piece of one character does
                done += 1
                if (own := score[done - 1] + cost * len(part[done - 1].encode())) > score[done]:
                    score[done], piece[done] = own, -1
            end += 1
            if (own := score[end - length] + s) > score[end]:
                score[end], piece[end] = own, i
            if length == 1:  # the last hit that ends here, and better than bytes
                done = end
        while done < n:
            done += 1
            if (own := score[done - 1] + cost * len(part[done - 1].encode())) > score[done]:
                score[done], piece[done] = own, -1
        ids: list[int] = []
        width = self.length
        while n:
            if (i := piece[n]) >= 0:
                ids.append(i)
                n -= width[i]
            else:
                ids += [self.byte_ids[b] for b in reversed(part[n - 1].encode())]
                n -= 1
        return ids[::-1]

    def solved(self, part: bytes) -> tuple[list[int], bool]:
        """Ids of a part (its spaces are marks), and if they decode to it. Short parts are remembered: those of the last two REMEMBERED."""
        if (got := self.fresh.get(part)) is None:
            if (got := self.older.get(part)) is None:
                ids = self.best(part.decode().replace(" ", MARK))
                got = ids, b"".join(map(self.text.__getitem__, ids)) == part
            if len(part) < 64:
                if len(self.fresh) >= REMEMBERED:
                    self.fresh, self.older = {}, self.fresh
                self.fresh[part] = got
        return got

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the len + 1 offsets of the texts, and if each text's ids decode to it.

        Spaces become marks and one mark goes before a text; nothing else is changed. Each distinct part is solved once.
        """
        texts = texts.fill_null("")
        plain = pc.replace_substring(texts, MARK, " ")
        led = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        data, at = flat(led)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[at[:-1][at[:-1] < at[1:]]] = True
        cuts = np.r_[np.flatnonzero(begins), len(data)].astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        solved = [self.solved(p) for p in parts.dictionary.to_pylist()]
        size = np.fromiter((len(i) for i, _ in solved), np.int64, len(solved))
        own = np.fromiter(chain.from_iterable(i for i, _ in solved), np.int32, int(size.sum()))
        which = parts.indices.to_numpy()
        n = size[which]
        ends = np.r_[0, np.cumsum(n)]
        ids = own[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n) + np.arange(ends[-1])]
        first = np.searchsorted(cuts[:-1], at)
        wrong = np.r_[0, np.cumsum(~np.fromiter((ok for _, ok in solved), bool, len(solved))[which])]
        exact = (np.diff(wrong[first]) == 0) & pc.equal(plain, texts).to_numpy(zero_copy_only=False)
        return ids, ends[first], exact

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode(errors="replace")


_codecs: dict[int, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """The task process's codec, built once."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), n_tokens and exact (decoding gives the text back) of each row, repeated rows too.

    Null and empty texts have no ids; null ids of rows stay null. A text that itself holds the space mark comes back
    with spaces there, and exact is false. Of segmentations of equal score the one whose last pieces are longer
    counts. Texts of any length are encoded whole, in memory of some 16 bytes a character of their longest run without
    a space. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: the model's pieces
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("exact", pa.bool_())])

    def run(batches):
        c = codec(sent.value)
        for batch in batches:
            for first, last in pieces(flat(batch["text"])[1]):
                part = batch.slice(first, last - first)
                ids, at, exact = c.encode_all(part["text"])
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part["doc_id"], listed, pa.array(np.diff(at), pa.int64()), pa.array(exact, pa.bool_())], schema=schema)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """encoded with text, the text of its ids. Null ids: null. Unknown ids are an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(column):
        c = codec(sent.value)
        return column.map(lambda ids: None if ids is None else c.decode(list(ids)))

    return encoded.withColumn("text", text(F.col(ids_col)))
