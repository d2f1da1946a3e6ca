"""Passages of a benchmark in documents, within an edit distance.

A test item with an error budget of k is split into k + 1 pieces. A passage within k edits
leaves one piece untouched, so exact piece hits find it; the place of the hit says where
the item would lie, and Myers' bit-parallel distance verifies it there.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items that are searched for in one pass over the documents.
BLOCK_CHARS = 4 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, per_cent: int) -> int:
    return length * per_cent // 100


def split(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 nearly equal pieces."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest distance of the pattern to a substring of text, the first end of such)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Searcher:
    def __init__(self, items: list[tuple[int, str]], per_cent: int):
        self.items = [(i, t, budget(len(t), per_cent)) for i, t in items if t]
        self.patterns: dict[int, tuple[dict, dict]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t, k) in enumerate(self.items):
            for offset, piece in split(t, k):
                places.setdefault(piece, []).append((x, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best passage; of equals, the first."""
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for end, (length, where) in self.automaton.iter(text) if self.items else ():
            for x, offset in where:
                i, item, k = self.items[x]
                if found.get(x, (1,))[0] == 0:
                    continue
                start = end + 1 - length - offset
                if start >= 0 and text.startswith(item, start):
                    found[x] = (0, start, start + len(item))
                    continue
                # hits of one diagonal band share a window of twice its width
                band = start // (k + 1)
                if tried.get((x, band)) is not None or k == 0:
                    continue
                tried[x, band] = 1
                low = max(0, band * (k + 1) - k)
                window = text[low : (band + 1) * (k + 1) + len(item) + k]
                if x not in self.patterns:
                    self.patterns[x] = bits(item), bits(item[::-1])
                forward, backward = self.patterns[x]
                d, stop = best_end(forward, len(item), window)
                if d <= k and d < found.get(x, (k + 1,))[0]:
                    _, back = best_end(backward, len(item), window[:stop][::-1])
                    found[x] = (d, low + stop - back, low + stop)
        return [(self.items[x][0], *f) for x, f in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, per_cent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end: each item that a document holds within per_cent % of its length in edits.

    Both are compared as ``normal`` texts; start and end (exclusive) are characters of the normal document. One row
    for each row of docs and item, its smallest distance, and the first such hit; repeated rows and null ids have rows each. Items without
    text are ignored, repeated items are found each. Null, empty and short documents have no rows of their own; texts of any length
    are searched whole; other columns are ignored, whatever their names; an empty table gives an empty result. Items are searched in blocks of BLOCK_CHARS, each sent to the
    tasks; the documents are read once for each block and never shuffled.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    found = None
    for b in range(blocks):
        # about BLOCK_CHARS characters: a bounded part of the items
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        sent = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, normal(r.text)) for r in rows))

        def run(batches, sent=sent):
            search = Searcher(sent.value, per_cent)
            for batch in batches:
                out = [(d, *f) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for f in search.find(normal(t.as_py()))]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        part = thin.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found
