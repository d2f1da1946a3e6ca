"""Collocations: phrases that stand together more often than their parts would, from word suffix trees built in groups.

Every word of a piece starts a suffix, cut off after ``longest`` words. The prefixes of all suffixes are partitioned
vertically: a cell of prefixes whose suffixes fit the memory budget goes, with its neighbours, to one group; a cell
over the budget is extended by one more word. A group holds whole subtrees, sorts its suffixes, and the
leaf totals between two branchings give the count of each node, so of each phrase. Groups know nothing
of each other and any number of them can be built at the same time.

Words are 64-bit hashes of language and word until the phrases are named at the end. Only words that are frequent
enough for a phrase are sent: a bitmap of fixed size tells them; a word let through by chance changes no count.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import unused, written
from .words import _BASE, _BYTE, _INVERSE, _LOWER, flat, mix, pieces, powers

U64 = np.uint64
#: Suffixes of a group, and bytes of text that are scanned at once (whole documents).
GROUP_SUFFIXES, PIECE = 1 << 19, 1 << 20
#: Bits of the map of frequent words, and the most cells of prefixes that are told apart.
BITMAP_BITS, MOST_CELLS = 26, 1 << 20
#: A language's rows are ranked in so many parts first.
PARTS = 16
_SUFFIX = np.dtype([("w2", "<u8"), ("w3", "<u8"), ("w4", "<u8"), ("n", "<u4")])
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_WORDS_DDL = "lang string, h long, word string, n long"
_WORDS_SCHEMA = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
_BLOCK_DDL = "level int, grp int, lang string, h long, suffixes binary"
_BLOCK_SCHEMA = pa.schema([("level", pa.int32()), ("grp", pa.int32()), ("lang", pa.string()), ("h", pa.int64()), ("suffixes", pa.large_binary())])
_NODE_DDL = "lang string, k int, w1 long, w2 long, w3 long, w4 long, n long, whole boolean"


def fold(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a path that one more word goes on."""
    return mix(path * U64(0x9E3779B97F4A7C15) + word)


class Scan:
    """Words of documents: byte spans, hashes with their language, and if the next word goes on in the same piece."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, first: int, last: int, salts: np.ndarray):
        bounds = offsets[first : last + 1] - offsets[first]
        self.data = _LOWER[text[offsets[first] : offsets[last]]]
        kind = _KIND[self.data]
        inside = kind == 0
        edge = np.zeros(len(self.data) + 1, bool)
        edge[bounds] = True
        before = np.r_[False, inside[:-1]]
        after = np.r_[inside[1:], False]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, len(self.data)), out=total[1:])
        own = (total[self.end] - total[self.start]) * powers(_INVERSE, len(self.data) + 1)[self.start]
        self.hash = np.maximum(mix(own ^ salts[first + self.doc]), U64(1))
        breaks = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        self.goes_on = (self.doc[1:] == self.doc[:-1]) & (breaks[1:] == breaks[:-1])


def scans(batches):
    """(batch, scan, document of the scan's first) of each piece of text."""
    for batch in batches:
        text, offsets = flat(batch["text"])
        langs = batch["lang"].dictionary_encode()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], U64)
        salts = salt[langs.indices.to_numpy()] if len(salt) else salt
        for first, last in pieces(offsets, PIECE):
            yield batch, Scan(text, offsets, first, last, salts), first


def count_words(batches):
    for batch, scan, first in scans(batches):
        h, at, n = np.unique(scan.hash, return_index=True, return_counts=True)
        size = scan.end[at] - scan.start[at]
        ends = np.r_[0, np.cumsum(size)]
        letters = scan.data[np.repeat(scan.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        words = pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())
        yield pa.record_batch([batch["lang"].take(pa.array(first + scan.doc[at])), pa.array(h.view(np.int64)), words, pa.array(n)], schema=_WORDS_SCHEMA)


@dataclass(frozen=True)
class Layout:
    """Where suffixes go: for each level and cell of prefixes its group, or -1 where the prefix needs one word more."""

    bits: int
    frequent: np.ndarray
    groups: tuple[np.ndarray, ...]

    def cells(self, paths: np.ndarray) -> np.ndarray:
        return (paths >> U64(64 - self.bits)).astype(np.int64)


def suffixes(scan: Scan, frequent: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of two or more frequent words, and their words (0 past the end) in ``longest`` rows."""
    h = scan.hash
    slot = (h >> U64(64 - BITMAP_BITS)).astype(np.int64)
    known = (frequent[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1
    link = scan.goes_on & known[1:] & known[:-1] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(link)
    rows, alive = [h[at]], np.ones(len(at), bool)
    for d in range(1, longest):
        step = at + d - 1
        alive = alive & (step < len(link))
        alive[alive] = link[step[alive]]
        word = np.zeros(len(at), U64)
        word[alive] = h[at[alive] + d]
        rows.append(word)
    return at, np.stack(rows) if len(at) else np.zeros((longest, 0), U64)


def paths(words: np.ndarray) -> list[np.ndarray]:
    """Hash of the first 1, 2, .. words of each suffix."""
    out = [words[0]]
    for w in words[1:]:
        out.append(fold(out[-1], w))
    return out


def bitmap(words: DataFrame) -> np.ndarray:
    """One bit for each range of hashes that a frequent word falls into: 8 MB, however many there are."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    lanes = words.select(F.shiftright(slot, 6).alias("lane"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = lanes.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), U64)
    out[got["lane"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return out


def packed(sizes: np.ndarray, budget: int, last: bool) -> np.ndarray:
    """Groups of neighbouring cells up to the budget; -1 for a cell over it, unless prefixes are at their last word."""
    over = sizes > budget
    within = np.where(over, budget if last else 0, sizes)
    group = (np.cumsum(within) - 1) // budget
    return np.where(over & (not last), -1, group).astype(np.int32)


def layout(docs: DataFrame, words: DataFrame, longest: int, budget: int) -> Layout:
    """Counts prefixes, one word first and more where a cell is over the budget, and packs them into groups."""
    frequent = bitmap(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = max(10, min(MOST_CELLS.bit_length() - 1, (8 * total // budget).bit_length()))
    sizes = np.zeros((longest, 1 << bits), np.int64)
    first = words.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    sizes[0, first["cell"].to_numpy()] = first["n"].to_numpy()
    if (sizes[0] > budget).any():
        sent = docs.sparkSession.sparkContext.broadcast(Layout(bits, frequent, (packed(sizes[0], budget, False),)))

        def count_prefixes(batches):
            plan, n = sent.value, np.zeros((longest, 1 << bits), np.int64)
            for _, scan, _ in scans(batches):
                _, w = suffixes(scan, plan.frequent, longest)
                w = w[:, plan.groups[0][plan.cells(w[0])] < 0]
                for level, path in enumerate(paths(w)[1:], 1):
                    n[level] += np.bincount(plan.cells(path), minlength=1 << bits)
            level, cell = np.nonzero(n)
            yield pa.record_batch([pa.array(level, pa.int32()), pa.array(cell, pa.int32()), pa.array(n[level, cell])], names=["level", "cell", "n"])

        more = docs.mapInArrow(count_prefixes, "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n")).toArrow()
        sizes[more["level"].to_numpy(), more["cell"].to_numpy()] = more["n"].to_numpy()
    return Layout(bits, frequent, tuple(packed(s, budget, k == longest - 1) for k, s in enumerate(sizes)))


def send(batches, plan: Layout, longest: int):
    """Distinct suffixes of each piece of text, a row for each first word and group."""
    for batch, scan, first in scans(batches):
        at, w = suffixes(scan, plan.frequent, longest)
        if len(at) == 0:
            continue
        own = paths(w)
        _, one, n = np.unique(own[-1], return_index=True, return_counts=True)
        at, w, own = at[one], w[:, one], [p[one] for p in own]
        level, group = np.ones(len(one), np.int32), plan.groups[0][plan.cells(own[0])]
        for k in range(1, longest):
            on = group < 0
            level[on] = k + 1
            group[on] = plan.groups[k][plan.cells(own[k][on])]
        order = np.lexsort((w[0], group, level))
        level, group, h = level[order], group[order], w[0][order]
        cuts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (group[1:] != group[:-1]) | (level[1:] != level[:-1])])
        rows = np.zeros(len(order), _SUFFIX)
        for name, words in zip(("w2", "w3", "w4"), w[1:]):
            rows[name] = words[order]
        rows["n"] = n[order]
        offsets = np.r_[cuts, len(order)].astype(np.int64) * _SUFFIX.itemsize
        blobs = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
        lang = batch["lang"].take(pa.array(first + scan.doc[at[order[cuts]]]))
        yield pa.record_batch([pa.array(level[cuts]), pa.array(group[cuts]), lang, pa.array(h[cuts].view(np.int64)), blobs], schema=_BLOCK_SCHEMA)


def subtrees(blocks: pa.Table, least: int, longest: int) -> pa.Table:
    """Nodes of two words or more of a group's subtrees, with the totals of their leaves.

    Suffixes are sorted, so that those below a node lie side by side; a node's count is the sum between two branchings.
    Nodes that are whole in this group are left out below ``least``.
    """
    level = blocks["level"][0].as_py()
    blobs = blocks["suffixes"].combine_chunks()
    data, at = flat(blobs)
    rows = np.frombuffer(data.tobytes(), _SUFFIX)
    row_of = np.repeat(np.arange(len(blobs)), np.diff(at) // _SUFFIX.itemsize)
    words = np.stack([blocks["h"].to_numpy().view(U64)[row_of], *(rows[c] for c in ("w2", "w3", "w4")[: longest - 1])])
    order = np.lexsort(words[::-1])
    words, n, row_of = words[:, order], rows["n"][order].astype(np.int64), row_of[order]
    branch = np.zeros(len(order), bool)
    branch[:1] = True
    out = []
    for depth in range(1, longest + 1):
        branch[1:] |= words[depth - 1, 1:] != words[depth - 1, :-1]
        if depth == 1:
            continue
        head = np.flatnonzero(branch)
        total = np.add.reduceat(n, head) if len(head) else n[:0]
        keep = (words[depth - 1, head] != 0) & (total >= (least if depth >= level else 1))
        head, total = head[keep], total[keep]
        own = [words[k, head].view(np.int64) if k < depth else np.zeros(len(head), np.int64) for k in range(4)]
        lang = blocks["lang"].take(pa.array(row_of[head]))
        out.append(pa.table({"lang": lang, "k": pa.array(np.full(len(head), depth, np.int32)), **{f"w{k + 1}": pa.array(w) for k, w in enumerate(own)}, "n": pa.array(total), "whole": pa.array(np.full(len(head), depth >= level))}))
    return pa.concat_tables(out)


def _key(*words: Column) -> Column:
    return F.xxhash64(*words, *[F.lit(0).cast("long")] * (4 - len(words)))


def _parts_of(lengths: range) -> dict[int, list[tuple[int, int, int]]]:
    """For phrases of k words: (first word, last word + 1, k) of each shorter run in them of one of these lengths."""
    return {k: [(i, i + m, k) for m in lengths if m < k for i in range(k - m + 1)] for k in range(2, 5)}


def mine(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, text_col: str = "text", lang_col: str = "lang", budget: int = GROUP_SUFFIXES) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; texts are split at ``.,;:!?`` and line ends (\\n to \\r) into pieces, these at spaces and tabs into
    words. n is the number of words of the language, a, l, r are counts of runs of words within pieces, overlaps
    included. Phrases of 2 to ``longest`` (at most 4) words are candidates from a = ``least`` on. Cut after its first words, a phrase has
    l = count of what lies before, r = count of the rest; its score is the lowest of floor(2000000 a / (l + r)) of its
    cuts, l and r those of that cut, of equal ones of the first. A candidate inside a longer one that has 80 % of its count
    goes. rank runs from 1 by score and a, highest first, then by phrase in the order of UTF-8 bytes, up to ``top``.

    Null texts are empty; null languages are ``und``; a language without candidates has no rows; repeated rows count each
    time. An empty table gives an empty result. Texts of any length are taken whole. Other columns are ignored, whatever
    their names. Words are told apart by 64-bit hashes; ``budget`` is how many suffixes a group may hold.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    sent_docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    words = written(sent_docs.mapInArrow(count_words, _WORDS_DDL).groupBy("lang", "h", "word").agg(F.sum("n").alias("n")), "words")
    often = words.where(F.col("n") >= least)
    plan = spark.sparkContext.broadcast(layout(sent_docs, often, longest, budget))  # two tables of fixed size
    blocks = sent_docs.mapInArrow(lambda b: send(b, plan.value, longest), _BLOCK_DDL)
    nodes = written(blocks.groupBy("level", "grp").applyInArrow(lambda t: subtrees(t, least, longest), _NODE_DDL), "nodes")
    names = ["lang", "k", "w1", "w2", "w3", "w4"]
    split = nodes.where("NOT whole").groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = nodes.where("whole").select(*names, "n").unionByName(split).select("*", _key(*map(F.col, names[2:])).alias("key"))

    w = [F.col(c) for c in names[2:]]
    inside = F.explode(F.when(F.col("k") == 4, F.array(*(_key(*w[i:j]) for i, j, _ in _parts_of(range(2, 4))[4]))).otherwise(F.array(*(_key(*w[i:j]) for i, j, _ in _parts_of(range(2, 4))[3]))))
    longer = found.where("k > 2").select(inside.alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    kept = found.join(longer, "key", "left").where("longer IS NULL OR 100 * longer < 80 * n").drop("longer")

    counts = found.select(F.col("key").alias("part"), F.col("n").alias("f")).unionByName(often.select(_key(F.col("h")).alias("part"), F.col("n").alias("f")))

    def cut(k: int) -> Column:
        return F.array(*(F.struct(F.lit(m).alias("m"), _key(*w[:m]).alias("left"), _key(*w[m:k]).alias("right")) for m in range(1, k)))

    cuts = kept.select("key", "n", F.explode(F.when(F.col("k") == 2, cut(2)).when(F.col("k") == 3, cut(3)).otherwise(cut(4))).alias("c")).select("key", "n", "c.*")
    both = cuts.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"), (F.col("l") + F.col("r")).cast("decimal(19,0)"))
    lowest = both.groupBy("key").agg(F.min(F.struct(score.alias("score"), "m", "l", "r")).alias("low")).select("key", "low.score", "low.l", "low.r")
    scored = written(kept.join(lowest, "key"), "scored")

    named = _named(_at_least(scored, top), words)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = _first(named, top, F.desc("score"), F.desc("n"), F.asc("phrase")).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


def _first(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each language with their rank: of parts of the language, then of what is left of these."""
    part = unused(rows, "part")
    some = rows.withColumn(part, F.pmod("key", F.lit(PARTS)))
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top).drop(part, "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _at_least(scored: DataFrame, top: int) -> DataFrame:
    """Rows that score no less than the language's row number ``top``; ties with it are all kept."""
    last = _first(scored.select("lang", "key", "score", "n"), top, F.desc("score"), F.desc("n")).where(F.col("rank") == top)
    limit = last.select("lang", F.col("score").alias("least_score"), F.col("n").alias("least_n"))
    return scored.join(limit, "lang", "left").where("least_score IS NULL OR score > least_score OR (score = least_score AND n >= least_n)").drop("least_score", "least_n")


def _named(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with phrase, their words looked up by hash."""
    listed = F.slice(F.array("w1", "w2", "w3", "w4"), F.lit(1), F.col("k"))
    each = rows.select("key", F.posexplode(listed).alias("at", "h")).join(words.select("h", "word"), "h")
    texts = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("own"))
    return rows.join(texts.select("key", F.concat_ws(" ", F.col("own.word")).alias("phrase")), "key")
