"""JSON out of model text: as it is, fenced, inside prose, or mended by a machine that knows strings and nesting."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
_FENCE_HEAD, _FENCE_TAIL = re.compile(r"^```(?:json)?\s*", re.IGNORECASE), re.compile(r"\s*```$")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_BARE = re.compile(r"[^\s\"'“”{}\[\]:：,，/`]+|/")
_NAMES = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null"}
#: Quotation marks and what ends them.
_QUOTES = {'"': '"', "'": "'", "“": "”"}
_ESCAPED = set('"\\/bfnrt')


def _no_constant(name: str):
    raise ValueError(name)


def strict(text: str) -> bool:
    """Is text JSON as the standard has it?"""
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def _string(text: str, at: int) -> tuple[str, int, bool]:
    """The string that starts at a quotation mark as JSON, where it ends, and if the text ended before it did."""
    end, out, n = _QUOTES[text[at]], ['"'], len(text)
    at += 1
    while at < n:
        c = text[at]
        if c == end:
            return "".join(out) + '"', at + 1, False
        if c == "\\":
            if at + 1 >= n:
                break
            c = text[at + 1]
            if c == "u":
                code = text[at + 2 : at + 6]
                if len(code) < 4 and at + 2 + len(code) >= n:
                    break
                whole = re.fullmatch("[0-9a-fA-F]{4}", code) is not None
                out.append(f"\\u{code}" if whole else "u")
                at += 6 if whole else 2
                continue
            out.append(f"\\{c}" if c in _ESCAPED else json.dumps(c)[1:-1])
            at += 2
            continue
        out.append('\\"' if c == '"' else json.dumps(c)[1:-1] if c < " " else c)
        at += 1
    return "".join(out) + '"', n, True


class _Open:
    """A container that is not closed yet: what is written before its next item, and the key that waits for a value."""

    __slots__ = ("colon", "closer", "items", "key")

    def __init__(self, closer: str):
        self.closer, self.items, self.key, self.colon = closer, 0, None, False


def mended(text: str, start: int = 0) -> tuple[str, int | None] | None:
    """JSON of the first object or array from ``start`` on, and where the text ended before it did (None: it did not); None without one.

    Comments, fences and commas before a closing bracket go; commas and colons that are missing come in; bare names and single quotes
    become strings, unknown escapes plain letters. A bracket that closes an outer container closes the inner ones with it. At the end of the text an open string
    is closed, a key without its value and a word that is none of JSON's are dropped, and what is open is closed.
    """
    found = re.compile(r"[{\[]").search(text, start)
    if not found:
        return None
    at, n = found.start(), len(text)
    out: list[str] = []
    stack: list[_Open] = []

    def begin() -> bool:
        """Writes what goes before a value; False where an object has no key for it."""
        if stack:
            top = stack[-1]
            if top.closer == "}" and top.key is None:
                return False
            if top.items:
                out.append(",")
            if top.closer == "}":
                out.append(f"{top.key}:")
            top.items, top.key, top.colon = top.items + 1, None, False
        return True

    def atom(value: str, name: bool) -> None:
        top = stack[-1]
        if top.closer == "}" and (top.key is None or (name and not top.colon)):
            top.key, top.colon = value if value[0] == '"' else json.dumps(value), False
        elif begin():
            out.append(value)

    while at < n:
        c = text[at]
        if c in "{[":
            if not begin():
                top = stack[-1]  # an object right inside an object: it gets an empty key
                top.key = '""'
                begin()
            out.append(c)
            stack.append(_Open("}" if c == "{" else "]"))
            at += 1
        elif c in "}]":
            at += 1
            if any(x.closer == c for x in stack):
                while True:
                    top = stack.pop()
                    out.append(top.closer)
                    if top.closer == c:
                        break
                if not stack:
                    return "".join(out), None
        elif c in _QUOTES:
            value, at, cut = _string(text, at)
            top = stack[-1]
            if cut and top.closer == "}" and top.key is None:
                break  # a key that was cut
            atom(value, name=True)
        elif c in ":：":
            stack[-1].colon = stack[-1].key is not None
            at += 1
        elif text.startswith("//", at):
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            at = n if end < 0 else end + 2
        elif text.startswith("```", at):
            at += 3
        elif c in ",，`" or c.isspace() or c < " ":
            at += 1
        else:
            word = _BARE.match(text, at)
            if word is None:
                at += 1
                continue
            word, at = word[0], word.end()
            number = _NUMBER.match(word)
            if at >= n:  # cut: only a number or a whole word of JSON stays
                value = number[0] if number else word if word in ("true", "false", "null") else None
                if value and not (stack[-1].closer == "}" and stack[-1].key is None):
                    atom(value, name=False)
                break
            if number and number.end() == len(word):
                atom(word, name=False)
            else:
                low = _NAMES.get(word.lower())
                key = stack[-1].closer == "}" and stack[-1].key is None
                atom(low if low and not key else json.dumps(word, ensure_ascii=False), name=low is None)
    while stack:
        out.append(stack.pop().closer)
    return "".join(out), n


def balanced(text: str) -> str | None:
    """The first object of text up to its own closing bracket; brackets inside strings do not count."""
    start = text.find("{")
    if start < 0:
        return None
    depth, inside, escaped = 0, False, False
    for at in range(start, len(text)):
        c = text[at]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[start : at + 1]
    return None


def found_json(text: str | None) -> tuple[str | None, str | None, int | None]:
    """(JSON, how it was found, where the text was cut): whole, fenced, inside, mended, cut, or nothing."""
    raw = (text or "").strip()
    whole = _FENCE_TAIL.sub("", _FENCE_HEAD.sub("", raw)).strip()
    if whole and strict(whole):
        return whole, "whole", None
    fence = _FENCE.search(raw)
    if fence and strict(fence[1].strip()):
        return fence[1].strip(), "fenced", None
    inside = balanced(whole)
    if inside and strict(inside):
        return inside, "inside", None
    got = mended(text or "", fence.start(1) if fence else 0)
    if got is None or not strict(got[0]):
        return None, None, None
    return got[0], "mended" if got[1] is None else "cut", got[1]


_FOUND = StructType([StructField("json", StringType()), StructField("how", StringType()), StructField("cut_at", IntegerType())])


def _lenient(texts: pd.Series) -> pd.DataFrame:
    known = {t: found_json(t) for t in set(texts)}  # equal texts of a batch are read once
    return pd.DataFrame([known[t] for t in texts], columns=["json", "how", "cut_at"]).astype({"json": object, "how": object, "cut_at": "Int32"})


def lenient_json(text: Column) -> Column:
    """A struct of json, how and cut_at, see found_json(); nulls where a text has no JSON that could be mended.

    Batches of texts go to Python by Arrow: no SQL function reads JSON that is broken.
    """
    return F.pandas_udf(_lenient, _FOUND)(text)
