"""Lines of text from positioned items of a page: tolerant grouping by height, and spaces where gaps are wide enough."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T

_NO_SPACE_BEFORE, _NO_SPACE_AFTER, _LETTER = re.compile(r"^[,.;:!?%\])}]"), re.compile(r"[(\[{]$"), re.compile("^[A-Za-z]$")

#: Items of pages that are measured at once, more if one page has more.
AT_ONCE = 1 << 17


def median(values: list[float]) -> float | None:
    own, n = sorted(values), len(values)
    return None if not n else own[n // 2] if n % 2 else (own[n // 2 - 1] + own[n // 2]) / 2


def group_lines(items: list[tuple[str, float, float, float, float]]) -> list[list[tuple[str, float, float, float, float]]]:
    """Items (text, x, y, width, height) in lines from the top, each from the left. An item joins the line before if its y is within
    .65 of the smaller height (2 at least) of the line's, which is the mean of its items'; a line is as high as its highest item."""
    lines: list[dict] = []
    for item in sorted((i for i in items if i[0].strip()), key=lambda i: (i[2], i[1])):
        last = lines[-1] if lines else None
        if last and abs(last["y"] - item[2]) <= max(2, min(last["height"], item[4]) * 0.65):
            last["items"].append(item)
            n = len(last["items"])
            last["y"] = (last["y"] * (n - 1) + item[2]) / n
            last["height"] = max(last["height"], item[4])
        else:
            lines.append({"y": item[2], "height": item[4], "items": [item]})
    return [sorted(x["items"], key=lambda i: i[1]) for x in lines]


def readable(line: list[tuple[str, float, float, float, float]]) -> str:
    """A line's items with a space where the gap is over a part of the usual width of a character; between single letters it must be wider,
    by the median of the line's gaps. None before a closing mark, none after an opening one."""
    width = median([w for w in (i[3] / max(len(i[0].strip()), 1) for i in line) if 0 < w < float("inf")])
    width = 8 if width is None else width
    gaps = [b[1] - (a[1] + a[3]) for a, b in zip(line, line[1:])]
    usual = median([g for g in gaps if g > 0]) or 0
    letters, words = max(width * 1.2, usual * 2.5, 3), max(width * 0.3, 1.5)
    out = line[0][0].strip()
    for a, b, gap in zip(line, line[1:], gaps):
        left, right = a[0].strip(), b[0].strip()
        single = _LETTER.match(left) and _LETTER.match(right)
        apart = gap > 0 and not _NO_SPACE_BEFORE.match(right) and not _NO_SPACE_AFTER.search(left) and gap > (letters if single else words)
        out += (" " if apart else "") + right
    return out


def page_lines(items: DataFrame, page: list[str], text_col: str = "text") -> DataFrame:
    """The page's columns, line (from 0, from the top), items, y, text. items: page, text, x, y, width, height.

    A page is one group, as large as a page is. Items without text count for nothing; null positions and sizes are 0. A line's text has letters that stand apart joined.
    """
    item = F.struct(F.col(text_col).alias("text"), *("x", "y", "width", "height"))
    return lines_of_pages(items.groupBy(*page).agg(F.collect_list(item).alias("_items")), "_items")


def lines_of_pages(pages: DataFrame, items_col: str) -> DataFrame:
    """As page_lines, of rows that are a page each: their other columns, and an array of structs text, x, y, width, height. A batch of pages is measured at once."""
    keep = [c for c in pages.columns if c != items_col]
    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        for batch in batches:
            counts = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(len(keep))), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(counts // AT_ONCE)) + 1  # whole pages
            for a, b in zip([0, *cuts], [*cuts, len(counts)]):
                part = batch.slice(a, b - a)
                found = _lines(part.column(len(keep)))
                at = found.pop("page")
                if len(at):
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(keep))), *found.values()], names=[*keep, *found])

    out = pages.select(*keep, F.col(items_col).alias("_items")).mapInArrow(run, f"{kinds}line int, items int, y double, text string")
    return out.withColumn("text", T.letters_joined(F.col("text")))


def _medians(values: np.ndarray, line: np.ndarray, n: int, otherwise: float) -> np.ndarray:
    """The median of the values of each of n lines."""
    order = np.lexsort((values, line))
    v, counts = values[order], np.bincount(line, minlength=n)
    out, some = np.full(n, otherwise, dtype=float), counts > 0
    first, c = (np.cumsum(counts) - counts)[some], counts[some]
    out[some] = np.where(c % 2 == 1, v[first + c // 2], (v[first + (c - 1) // 2] + v[first + c // 2]) / 2)
    return out


def _starts(page: np.ndarray, y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Which items, from the top of each page, begin a line: the rule of group_lines.

    An item further below the last one than any line reaches surely begins one, and items that are closer together than the lowest of
    them allows surely share one. Only what lies between two sure beginnings and is not sure is walked through item by item.
    """
    slack = 1e-9 * (1 + np.abs(y))  # more than means are off by rounding
    sure = np.append(True, (page[1:] != page[:-1]) | (y[1:] - y[:-1] > np.maximum(2, height[1:] * 0.65) + slack[1:]))
    first = np.flatnonzero(sure)
    last = np.append(first[1:], len(y)) - 1
    one = y[last] - y[first] <= np.maximum(2, np.minimum.reduceat(height, first) * 0.65) - slack[last]
    for a, b in zip(first[~one].tolist(), last[~one].tolist()):
        mean, high, n = 0.0, 0.0, 0
        for k, (at, h) in enumerate(zip(y[a : b + 1].tolist(), height[a : b + 1].tolist()), a):
            if n and abs(mean - at) <= max(2, min(high, h) * 0.65):
                n += 1
                mean, high = (mean * (n - 1) + at) / n, max(high, h)
            else:
                mean, high, n, sure[k] = at, h, 1, True
    return sure


def _lines(items: pa.ListArray) -> dict:
    """page (its place), line, items, y and text of the lines of an array of pages: group_lines and readable over all pages at once."""
    page, flat = pc.list_parent_indices(items).to_numpy(), items.flatten()
    text = pc.utf8_trim_whitespace(pc.fill_null(pc.struct_field(flat, "text"), ""))
    x, y, width, height = (pc.fill_null(pc.cast(pc.struct_field(flat, c), pa.float64(), safe=False), 0.0).to_numpy() for c in ("x", "y", "width", "height"))
    there = np.flatnonzero(pc.binary_length(text).to_numpy() > 0)
    if not len(there):
        return {"page": pa.array([], pa.int64())}
    order = there[np.lexsort((x[there], y[there], page[there]))]
    starts = _starts(page[order], y[order], height[order])
    line = np.cumsum(starts) - 1
    order = order[np.lexsort((x[order], line))]
    first, n = np.flatnonzero(starts), int(starts.sum())
    text, x, y, width, own = text.take(pa.array(order)), x[order], y[order], width[order], page[order][first]
    each = width / np.maximum(pc.utf8_length(text).to_numpy(), 1)
    valid = (each > 0) & (each < np.inf)
    usual_width = _medians(each[valid], line[valid], n, 8.0)
    gap = np.concatenate(([0.0], x[1:] - (x[:-1] + width[:-1])))
    gap[first] = 0
    usual = _medians(gap[gap > 0], line[gap > 0], n, 0.0)
    letters, words = np.maximum(np.maximum(usual_width * 1.2, usual * 2.5), 3)[line], np.maximum(usual_width * 0.3, 1.5)[line]
    letter = pc.match_substring_regex(text, _LETTER.pattern).to_numpy(zero_copy_only=False)
    closing = pc.match_substring_regex(text, _NO_SPACE_BEFORE.pattern).to_numpy(zero_copy_only=False)
    opening = pc.match_substring_regex(text, _NO_SPACE_AFTER.pattern).to_numpy(zero_copy_only=False)
    limit = np.where(letter & np.roll(letter, 1), letters, words)
    apart = (gap > 0) & ~closing & ~np.roll(opening, 1) & (gap > limit)
    pieces = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(apart.astype(np.int8))), text, "")
    ends = np.append(first, len(order))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), "")
    top = np.append(True, own[1:] != own[:-1])
    place = np.arange(n) - np.maximum.accumulate(np.where(top, np.arange(n), 0))
    return {"page": pa.array(own), "line": pa.array(place, pa.int32()), "items": pa.array(np.diff(ends), pa.int32()), "y": pa.array(np.add.reduceat(y, first) / np.diff(ends)), "text": joined}
