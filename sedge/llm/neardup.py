"""Near-duplicate classes by MinHash, with sequential Bayesian verification.

1. Each document becomes its set of distinct word shingles (64-bit hashes), a key of the
   whole set and BANDS x ROWS minimum hashes. Documents with equal sets are one class from here on.
2. Bands with an equal in another class make candidates. A band's members are first
   compared with its smallest only (a star), so a band of any size gives one pair a member.
3. Signatures of a candidate are compared batch by batch; it is dropped as
   soon as the posterior chance that its similarity reaches the threshold is under MISS. Looks use 16 bits of
   LOOKS entries; chance agreements only keep a pair longer.
4. Survivors are confirmed on the full sets.
5. Classes that share a band but are in different components after that are compared pair by pair (in random
   stars, then all that counts of their shingles by hash range do not rule out), so no link is lost to the stars.
   Members of a band of over CELL meet by their rarest shingles in its place: two sets at the threshold share one of
   the first n - ceil(threshold * n) + 1 in any order of all shingles, so this is exact too.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import checkpointed, swept
from .words import Words, flat, mix, pieces

#: A pair at the threshold of 0.8 shares no band with a chance of (1 - 0.8 ** 6) ** 48 = 5e-7.
BANDS, ROWS = 48, 6
#: Signature entries kept for looks at a pair, how many a look compares, and the chance of dropping a true link in one look.
LOOKS, BATCH, MISS = 128, 32, 1e-8
#: So many ids (8 bytes each) are broadcast to pick their texts while these are read; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Counts that stand for a set where a whole band is compared, and rows that are compared at once.
PROFILE, CELL = 512, 4096
#: Slots in which shingles are counted to put the rare ones first; the order is exact, the counts need not be.
SLOTS = 1 << 20
U16, U32, U64 = np.uint16, np.uint32, np.uint64

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | U64(1)).astype(U32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(U32)

_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def _sets(batch: pa.RecordBatch, words: int):
    """The sorted distinct shingle hashes of each document in turn."""
    text, offsets = flat(batch["text"])
    for first, last in pieces(offsets):
        w = Words(text, offsets, first, last, lower=True)
        start, h = w.windows(words)
        at = np.searchsorted(w.doc[start], np.arange(w.n_docs + 1))
        for d in range(w.n_docs):
            if at[d] < at[d + 1]:
                yield np.unique(h[at[d] : at[d + 1]])
            else:  # fewer words than a shingle has: the whole sequence, marked by its length
                own = w.hash[w.at[d] : w.at[d + 1]]
                yield mix(np.array([sum(int(x) * (k + 2) for k, x in enumerate(own)) + len(own) & (1 << 64) - 1], U64)) if len(own) else own


def _signature(s: np.ndarray) -> np.ndarray:
    x = (s >> U64(32)).astype(U32)
    low = np.full(len(_A), 0xFFFFFFFF, U32)
    for i in range(0, len(x), 512):  # stays in the cache
        np.minimum(low, (x[None, i : i + 512] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return low


def _featured(batches, words: int):
    salts = mix(np.arange(BANDS, dtype=U64) + U64(77))
    for batch in batches:
        n, key1, key2, signatures, bands = [], [], [], [], []
        for s in _sets(batch, words):
            n.append(len(s))
            key1.append(int(s.sum(dtype=U64).astype(np.int64)))
            key2.append(int(mix(s).sum(dtype=U64).astype(np.int64)))
            if len(s):
                low = _signature(s)
                rows = low.reshape(BANDS, ROWS).astype(U64)
                band = salts.copy()
                for k in range(ROWS):
                    band = mix(band ^ rows[:, k])
                signatures.append((low[:LOOKS] >> U32(8)).astype(U16).tobytes())
                bands.append(band.astype(np.int64))
            else:
                signatures.append(None)
                bands.append(np.zeros(0, np.int64))
        yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_FEATURES)


def _sizes(batches, words: int):
    for batch in batches:
        yield pa.record_batch([batch["doc_id"], pa.array([len(s) for s in _sets(batch, words)], pa.int64())], names=["doc_id", "n_shingles"])


def _packed_sets(batches, words: int):
    for batch in batches:
        yield pa.record_batch([batch["doc_id"], pa.array([s.tobytes() for s in _sets(batch, words)], pa.binary())], schema=_SETS)


@cache
def least_matches(per_cent: int, entries: int = LOOKS) -> tuple[int, ...]:
    """For 1, 2, .. batches: the fewest equal entries with which a pair stays.

    With a flat prior, m equal of n entries give similarity a Beta(m + 1, n - m + 1); its chance of s
    or more is that of at most m heads in n + 1 throws of a coin of bias s.
    """
    s, out = per_cent / 100, []
    for n in range(BATCH, entries + 1, BATCH):
        chance, m = 0.0, -1
        while chance < MISS:
            m += 1
            chance += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _unpruned(batches, least: tuple[int, ...]):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), U16).reshape(len(batch), -1) for c in ("sa", "sb"))
        stay, m = np.arange(len(batch)), np.zeros(len(batch), np.int64)
        for k, low in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            m[stay] += (x[stay, part] == y[stay, part]).sum(axis=1)
            stay = stay[m[stay] >= low]
        yield pa.record_batch([batch["a"].take(pa.array(stay)), batch["b"].take(pa.array(stay))], names=["a", "b"])


def _confirmed(batches, per_cent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _profiled(batches, words: int):
    """How many shingles of each document fall in each of PROFILE ranges: a byte each, and the sum of what bytes can't hold."""
    for batch in batches:
        counted, over = [], []
        for x in _sets(batch, words):
            n = np.bincount((x >> U64(40)).astype(np.int64) % PROFILE, minlength=PROFILE)
            counted.append(np.minimum(n, 255).astype(np.uint8).tobytes())
            over.append(int(np.maximum(n - 255, 0).sum()))
        yield pa.record_batch([batch["doc_id"], pa.array(counted, pa.binary()), pa.array(over, pa.int64())], names=["doc_id", "profile", "over"])


def _counted(batches, words: int):
    """slot, n: how many shingles of a task's documents fall in each of SLOTS."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for x in _sets(batch, words):
            np.add.at(total, (x % U64(SLOTS)).astype(np.int64), 1)
    slot = np.flatnonzero(total)
    for i in range(0, len(slot), 1 << 16):
        part = slot[i : i + (1 << 16)]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["slot", "n"])


def _prefixes(batches, words: int, per_cent: int, often: np.ndarray):
    """doc_id and, as band, each of its rarest shingles of which a linked document must share one."""
    for batch in batches:
        ids, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d, x in zip(batch["doc_id"].to_pylist(), _sets(batch, words), strict=True):
            first = len(x) + (-per_cent * len(x) // 100) + 1
            found.append(x[np.lexsort((x, often[(x % U64(SLOTS)).astype(np.int64)]))[:first]].astype(np.int64))
            ids.append(np.full(len(found[-1]), d, np.int64))
        yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], names=["doc_id", "band"])


def _by_rare_shingles(tagged: DataFrame, docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """tagged (band, doc_id, component) with shared rare shingles of docs, the texts of its ids, as bands."""
    slots = docs.mapInArrow(lambda it: _counted(it, words), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(often)
    rare = docs.mapInArrow(lambda it: _prefixes(it, words, per_cent, sent.value), "doc_id long, band long")
    rare = checkpointed(rare.distinct().join(tagged.select("doc_id", "component").distinct(), "doc_id").select("band", "doc_id", "component"))
    return rare.join(_open_bands(rare), "band")


def _open_bands(tagged: DataFrame) -> DataFrame:
    """Bands with members of more than one component."""
    return tagged.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")


def _cell_pairs(rows: pa.Table, per_cent: int) -> pa.Table:
    """Pairs of a cell's documents, of different components, that profiles do not rule out.

    Two sets share at most the sum of the smaller counts (and the smaller excess), so what is left out has no link.
    """
    rows = rows.sort_by([("band", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("doc_id", "ascending")])
    band, lo, hi, block, ids, comp, over = (rows[c].to_numpy() for c in ("band", "lo", "hi", "block", "doc_id", "component", "over"))
    x = np.frombuffer(b"".join(rows["profile"].to_pylist()), np.uint8).reshape(len(rows), PROFILE)
    size = x.sum(axis=1, dtype=np.int64) + over
    cuts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
    found_a, found_b = [], []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        names, inverse, n = np.unique(comp[i:j], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        few = np.flatnonzero(inverse != n.argmax())  # all but the largest component, each against all
        for k in few.tolist():
            other = inverse != inverse[k]
            if lo[i] != hi[i]:
                other &= block[i:j] != block[i + k]
            at = np.flatnonzero(other)
            both = np.minimum(x[i + k], x[i + at]).sum(axis=1, dtype=np.int64) + np.minimum(over[i + k], over[i + at])
            near = at[100 * both >= per_cent * (size[i + k] + size[i + at] - both)]
            found_a.append(np.full(len(near), ids[i + k]))
            found_b.append(ids[i + near])
    a = np.concatenate([np.zeros(0, np.int64), *found_a])
    b = np.concatenate([np.zeros(0, np.int64), *found_b])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _met_in_cells(tagged: DataFrame, profiles: DataFrame, per_cent: int) -> DataFrame:
    """Candidate pairs of different components in a band; a large band is cut into cells of CELL rows each way."""
    blocks = tagged.groupBy("band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    dealt = tagged.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "doc_id", "component")
    # rows as they are after the copies, so that a bucket holds about one cell
    copied = tagged.groupBy("band").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.ceil(F.col("n") / CELL))).first()[0] or 0
    groups = max(4, copied // CELL)
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("band", "lo", "hi"), F.lit(groups)).cast("int")).join(profiles, "doc_id")
    return cells.groupBy("bucket").applyInArrow(lambda t: _cell_pairs(t, per_cent), "a long, b long")


def _with(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b, sa, sb: the values of both sides."""
    left = values.select(F.col("doc_id").alias("a"), F.col(column).alias("sa"))
    right = values.select(F.col("doc_id").alias("b"), F.col(column).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (it is that one itself).

    Documents are linked if their sets of distinct shingles (``words`` words, A-Z lowered) have
    a Jaccard similarity of per_cent / 100 or more; see the module on what is exact. A text with fewer words is one
    shingle, its whole sequence. Texts without words and null texts have no shingles and are alone. Rows
    that share a doc_id are in one component with all that any of them links to. Rows of a null id have
    their n_shingles, no component_id, and are kept; they link nothing. Texts of any length are taken whole; other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nameless = every.where("doc_id IS NULL").mapInArrow(lambda it: _sizes(it, words), "doc_id long, n_shingles long")
    nameless = nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    docs = every.where("doc_id IS NOT NULL")
    features = checkpointed(docs.mapInArrow(lambda it: _featured(it, words), "doc_id long, n_shingles long, key1 long, key2 long, signature binary, bands array<bigint>"))
    keys = ["n_shingles", "key1", "key2"]
    thin = features.select("doc_id", *keys)
    classes = thin.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    members = checkpointed(thin.join(classes, keys, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    # only classes' representatives go on; the semi join carries ids, not signatures, through the shuffle
    reps = features.join(members.where("n_shingles > 0 AND doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    signatures = reps.select("doc_id", "signature")
    entries = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    entries = checkpointed(entries.join(shared, "band").select("band", "doc_id", "low"))

    def picked(ids: DataFrame) -> DataFrame:
        ids = checkpointed(ids.distinct())
        return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        left = checkpointed(_with(pairs, signatures, "signature").mapInArrow(lambda it: _unpruned(it, least_matches(per_cent)), "a long, b long"))
        ids = left.select(F.col("a").alias("doc_id")).unionByName(left.select(F.col("b").alias("doc_id")))
        sets = picked(ids).mapInArrow(lambda it: _packed_sets(it, words), "doc_id long, shingles binary")
        return _with(left, sets, "shingles").mapInArrow(lambda it: _confirmed(it, per_cent), "a long, b long")

    # rows of one id are one document: their classes are linked
    own = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high").select("doc_id", "a")
    own = members.join(own, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    links = checkpointed(own.unionByName(linked(entries.where("doc_id != low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct())))
    for k in range(1, rounds + 1):
        swept(docs.sparkSession)
        own = components(links)
        tagged = entries.join(own.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        tagged = tagged.join(_open_bands(tagged), "band")
        if k < rounds:  # a star from a member drawn anew
            drawn = tagged.groupBy("band").agg(F.min_by(F.struct("doc_id", "component"), F.xxhash64("band", "doc_id", F.lit(k))).alias("c"))
            met = tagged.join(drawn, "band").where("component != c.component").select(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b"))
        else:
            tagged = checkpointed(tagged)
            hot = checkpointed(tagged.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("band"))
            if not hot.isEmpty():
                many = checkpointed(tagged.join(hot, "band"))
                rare = _by_rare_shingles(many, picked(many.select("doc_id")), words, per_cent)
                tagged = checkpointed(tagged.join(hot, "band", "left_anti").unionByName(rare))
            met = _met_in_cells(tagged, picked(tagged.select("doc_id")).mapInArrow(lambda it: _profiled(it, words), "doc_id long, profile binary, over long"), per_cent)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # what is known goes on as each id's link to its component
        known = own.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        links = checkpointed(known.unionByName(linked(met)))
    whole = components(links)
    out = members.join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left")
    same = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return same.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(nameless)
