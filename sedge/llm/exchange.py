"""Segments and buckets: hash values of a whole corpus compared in packed blocks.

Documents are dealt to segments (by a hash of their id and text). A segment sends each
bucket the sorted distinct hashes of the bucket's range as one packed row, so
a hash that fills a third of all documents reaches its bucket once per segment
at most. The bucket answers with one value per hash sent, in the order
sent. Segments and buckets are both sized from the corpus, so neither grows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BYTES = 8 << 20
U64 = np.uint64


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def segment(n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("seg")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """0 .. n - 1, rising with the hash; n under 2 ** 31."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def runs(numbers: np.ndarray):
    """(number, from, to) of each run of equal numbers."""
    cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True]) if len(numbers) else np.zeros(1, np.int64)
    yield from zip(numbers[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def dealt(h: np.ndarray, n: int):
    """(bucket, from, to) of sorted hashes: work in proportion to the hashes, whatever the number of buckets."""
    return runs(bucket_of(h, n))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs, byte by byte, so that small ones compress."""
    x = np.asarray(x).astype(U64)
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.reshape(-1).view(U64).astype(np.int64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def answers(replies: pa.Table, h: np.ndarray, n: int) -> np.ndarray:
    """Bit answers of all buckets, put in the order of the hashes sent."""
    got = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True))
    parts = [unpack_bits(got[b], to - at) for b, at, to in dealt(h, n)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)
