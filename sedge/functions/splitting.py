"""Cutting texts into chunks where they part best. The cutting of one text is a small helper; texts are spread over the tasks by Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text is parted first, next, .. and last between any two characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", " ", "")
CHUNKS = "array<struct<start:int,end:int>>"


def parted(text: str, start: int, end: int, separators: tuple[str, ...]) -> tuple[list[tuple[int, int]], tuple[str, ...]]:
    """Pieces of text[start:end], each but the first beginning with the first separator that is there, and the separators that come after it."""
    for k, sep in enumerate(separators):
        if sep == "":
            return [(i, i + 1) for i in range(start, end)], ()
        if text.find(sep, start, end) >= 0:
            cuts, at = [start], text.find(sep, start + 1, end)
            while at >= 0:
                cuts.append(at)
                at = text.find(sep, at + len(sep), end)
            return [(a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if a < b], separators[k + 1 :]
    return [(start, end)], ()


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters, without white space at their ends.

    Pieces are gathered until the next would pass size; the following chunk begins with as many of the last pieces as overlap allows. A
    piece that is too long itself is cut by the separators after the one that parted it.
    """
    out: list[tuple[int, int]] = []

    def gathered(pieces: list[tuple[int, int]]) -> None:
        first = 0
        for k, (_, end) in enumerate(pieces):
            if end - pieces[first][0] > size and k > first:
                out.append((pieces[first][0], pieces[k - 1][1]))
                # drop from the front what is beyond the overlap, or does not leave room
                while first < k and (pieces[k - 1][1] - pieces[first][0] > overlap or end - pieces[first][0] > size):
                    first += 1
        if pieces:
            out.append((pieces[first][0], pieces[-1][1]))

    def cut(start: int, end: int, rest: tuple[str, ...]) -> None:
        pieces, later = parted(text, start, end, rest)
        small: list[tuple[int, int]] = []
        for a, b in pieces:
            if b - a <= size:
                small.append((a, b))
                continue
            gathered(small)
            small = []
            if later:
                cut(a, b, later)
            else:
                out.append((a, b))
        gathered(small)

    cut(0, len(text), separators)
    trimmed = []
    for a, b in out:
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
        if a < b:
            trimmed.append((a, b))
    return trimmed


def chunks_of(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Array of (start, end) by recursive_chunks; null and empty texts have none."""
    if not 100 <= size <= 4000 or not 0 <= overlap <= size // 2:
        raise ValueError("a chunk has 100 to 4000 characters, of which half may overlap")

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in recursive_chunks(t, size, overlap)] if t else [])

    return F.pandas_udf(cut, CHUNKS)(text)


def pages_of(text: Column, target: int = 600, least: int = 20) -> Column:
    """Pages of a text: at form feeds, else before headings of up to three marks, else paragraphs gathered to target characters.

    Pages under least characters go, but for gathered ones that reached the target; a text without any page is one.
    """
    def long(pages: Column) -> Column:
        return F.filter(F.transform(pages, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: F.length(p) >= least)

    headed = F.split(text, "\\n(?=#{1,3}\\s)")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        grown = F.concat(s["open"], F.when(s["open"] != "", F.lit("\n\n")).otherwise(F.lit("")), F.regexp_replace(p, "^\\s+|\\s+$", ""))
        full = F.length(grown) >= target
        return F.struct(F.when(full, F.array_append(s["done"], grown)).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    gathered = F.aggregate(F.split(text, "\\n{2,}"), start, step, lambda s: F.when(F.length(F.regexp_replace(s["open"], "^\\s+|\\s+$", "")) >= least, F.array_append(s["done"], F.regexp_replace(s["open"], "^\\s+|\\s+$", ""))).otherwise(s["done"]))
    return F.when(text.contains("\f"), long(F.split(text, "\f"))).when(F.size(headed) > 1, long(headed)).otherwise(F.when(F.size(gathered) > 0, gathered).otherwise(F.array(text)))
