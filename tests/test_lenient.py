"""Mended JSON against texts worked out by hand, and cuts of all lengths against a plain search for the longest readable start."""

import json
import random

import pytest
from sedge.functions import lenient
from sedge.plans.queries import QUERIES


@pytest.mark.parametrize(
    "text, value, how",
    [
        ('{"a": 1}', {"a": 1}, "whole"), ("```json\n[1, 2]\n```", [1, 2], "whole"), ('So: ```json\n{"a": "}"}\n``` and more {', {"a": "}"}, "fenced"), ('Here {"a": {"b": "x}\\"{"}} and {"c": 1}', {"a": {"b": 'x}"{'}}, "inside"),
        ('{"a": 1,}', {"a": 1}, "mended"), ('{"a": [1, 2,], "b": {},}', {"a": [1, 2], "b": {}}, "mended"), ("{a: 1, b_2: 'x', 'c': \"it's\"}", {"a": 1, "b_2": "x", "c": "it's"}, "mended"),
        ('{"a": 1 // one\n, /* two { */ "b": "http://x//y"}', {"a": 1, "b": "http://x//y"}, "mended"), ('{"a": "[", "b": [1 2 "x" "y"]}', {"a": "[", "b": [1, 2, "x", "y"]}, "mended"), ('{"a"：1，"b"： “z”}', {"a": 1, "b": "z"}, "mended"),
        ('{"a": True, "b": None, "c": NaN, "d": word}', {"a": True, "b": None, "c": None, "d": "word"}, "mended"), ('{"a": "line\nbreak\ttab"}', {"a": "line\nbreak\ttab"}, "mended"), ('{"a": [{"b": 1}{"c": 2}]}', {"a": [{"b": 1}, {"c": 2}]}, "mended"),
        ('{"a": "\\q\\x41"}', {"a": "qx41"}, "mended"), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}, "cut"), ('{"a": [1, {"b": 2]}', {"a": [1, {"b": 2}]}, "mended"), ('{"entities": [{"name": "x"}, {"na', {"entities": [{"name": "x"}, {}]}, "cut"),
        ('{"a" 1 "b" 2,}', {"a": 1, "b": 2}, "mended"), ('text [1, 2, {"x": [}', [1, 2, {"x": []}], "cut"), ("no json", None, None), ("", None, None), (None, None, None), ("12", 12, "whole"), ("{", {}, "cut"), ("}{", {}, "cut"), ('{"a": 01}', {"a": "01"}, "mended"),
        ('```\n{"a": 1,}\n``` tail }', {"a": 1}, "mended"), ('{"a": "\\ud83d\\ude00", "b": "\\u00e9",}', {"a": "\U0001f600", "b": "é"}, "mended"), ("{{}}", {"": {}}, "mended"),
    ],
)
def test_texts(text, value, how):
    got, by, cut = lenient.found_json(text)
    assert by == how and (json.loads(got) if got is not None else None) == value and (cut == len(text) if how == "cut" else cut is None)


def made(r, depth=0):
    kind = r.choice("onsabe" if depth < 3 else "nsb")
    if kind == "o":
        return {r.choice(["k", "key 2", "é", 'q"', "a\\b", "{", "]"]) + str(i): made(r, depth + 1) for i in range(r.randrange(4))}
    if kind == "a":
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return {"n": r.choice([0, -1, 12, 1.5, -0.25, 1e20, 123456789]), "s": r.choice(["", "x", 'a"b', "{[", "back\\", "\n", "é漢", "\U0001f600", ",:"]), "b": r.choice([True, False, None]), "e": {}}[kind]


def longest(text):
    """The value of the longest start that can be read once strings and brackets that are open there are closed."""
    for end in range(len(text), 0, -1):
        part, stack, inside, escaped = text[:end], [], False, False
        for c in part:
            if escaped:
                escaped = False
            elif inside:
                escaped, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]":
                stack.pop()
        closers = "".join(reversed(stack))
        try:
            return json.loads(part + ('"' if inside else "") + closers)
        except ValueError:
            continue
    return None


def test_cuts_of_every_length():
    r = random.Random(4)
    for _ in range(150):
        for ascii_only in (True, False):
            text = json.dumps({"root": made(r), "x": made(r)}, ensure_ascii=ascii_only, indent=r.choice([None, 1]))
            for n in range(1, len(text) + 1):
                got = lenient.found_json(text[:n])[0]
                assert json.loads(got) == longest(text[:n].rstrip()), text[:n]


def test_deep_and_long():
    assert lenient.mended("[" * 100_000)[0] == "[" * 100_000 + "]" * 100_000
    assert lenient.found_json('{"a": "' + "x" * 2_000_000)[1] == "cut"


def test_queries_over_all_events(spark):
    path = "/root/testdata/sf0.001"
    stored = {r.event_id: r.props for r in spark.read.parquet(f"{path}/events.parquet").collect()}
    got = {r.event_id: (r.lengths, r.found, r.total) for r in QUERIES["f34_cut_json"](spark, path).collect()}
    for i, p in stored.items():
        own = [longest(p[:n]) for n in range(1, len(p) + 1)]
        ks = [v["k"] for v in own if v and "k" in v]
        assert got[i] == (len(p), len(ks), sum(ks))


def test_equal_texts_are_read_once(monkeypatch):
    import pandas as pd

    met, plain = [], lenient.found_json
    monkeypatch.setattr(lenient, "found_json", lambda t: met.append(t) or plain(t))
    got = lenient._lenient(pd.Series(['{"k": 1', None, '{"k": 1', "x", None], dtype=object))
    assert sorted(map(str, met)) == ["None", "x", '{"k": 1'] and got["json"].tolist()[0] == got["json"].tolist()[2] == '{"k":1}'
