"""Lines of positioned items against a plain loop."""

import random
import statistics

from sedge.operators import lines


def plain(items):
    """Every item in turn, with lists of the lines so far; then gaps between neighbours."""
    rows = []
    for t, x, y, w, h in sorted([i for i in items if i[0].strip()], key=lambda i: (i[2], i[1])):
        if rows and abs(rows[-1][0] - y) <= max(2, min(rows[-1][1], h) * 0.65):
            row = rows[-1]
            row[2].append((t, x, y, w, h))
            row[0] = (row[0] * (len(row[2]) - 1) + y) / len(row[2])
            row[1] = max(row[1], h)
        else:
            rows.append([y, h, [(t, x, y, w, h)]])
    out = []
    for _, _, own in rows:
        own.sort(key=lambda i: i[1])
        widths = [w / max(len(t.strip()), 1) for t, _, _, w, _ in own if w > 0]
        width = statistics.median(widths) if widths else 8
        gaps = [b[1] - a[1] - a[3] for a, b in zip(own, own[1:])]
        usual = statistics.median([g for g in gaps if g > 0]) if any(g > 0 for g in gaps) else 0
        text = own[0][0].strip()
        for a, b in zip(own, own[1:]):
            x, y = a[0].strip(), b[0].strip()
            gap = b[1] - (a[1] + a[3])
            letters = all(len(z) == 1 and z.isascii() and z.isalpha() for z in (x, y))
            limit = max(width * 1.2, usual * 2.5, 3) if letters else max(width * 0.3, 1.5)
            if gap > 0 and y[0] not in ",.;:!?%])}" and x[-1] not in "([{" and gap > limit:
                text += " "
            text += y
        out.append((len(own), text))
    return out


def test_pages_of_items(spark):
    r = random.Random(1)
    pages = {}
    for page in range(40):
        pages[page] = [(r.choice(["word", "a", "b", "(", ")", ",", "x.", " ", "", "漢字", "two words"]), r.choice([0, 10, 11, 18, 25, 40, 41.5, 60]) + r.random(), r.choice([0, 1, 2, 3, 7, 7.5, 14, 30]), r.choice([0, 4, 6, 9.5]), r.choice([0, 5, 10, 12])) for _ in range(r.randrange(0, 25))]
    pages = {p: [(t, *map(float, own)) for t, *own in items] for p, items in pages.items()}
    for items in pages.values():
        assert [(len(x), lines.readable(x)) for x in lines.group_lines(items)] == plain(items)
    rows = [(p, *i, "z") for p, items in pages.items() for i in items] + [(99, None, None, None, None, None, "z"), (98, "one", None, 2.0, None, None, "z")]
    df = spark.createDataFrame(rows, "page long, text string, x double, y double, width double, height double, line string").repartition(3)
    got = {}
    for x in lines.page_lines(df, ["page"]).orderBy("page", "line").collect():
        got.setdefault(x.page, []).append((x.line, x.items))
    want = {p: [(k, n) for k, (n, _) in enumerate(plain(items))] for p, items in pages.items()} | {98: [(0, 1)]}
    assert got == {p: x for p, x in want.items() if x}


def test_no_items(spark):
    assert lines.page_lines(spark.createDataFrame([], "page int, text string, x int, y int, width int, height int"), ["page"]).count() == 0
    assert lines.group_lines([]) == []


def loose(items):
    """Items with a place and size that group_lines and readable take as they are."""
    return [(t or "", *(float(v or 0) for v in own)) for t, *own in items]


def test_pages_at_once_as_one_by_one(spark, monkeypatch):
    r = random.Random(2)
    texts = ["word", "a", "b", "c", "(", ")", ",", "x.", " ", "", "\x1c", "漢字", "two words", "[q", "é", None]
    pages = {p: [(r.choice(texts), r.randrange(100) + r.random(), r.choice([0, 1, 2, 3, 6.5, 7, 13.1, 14, 30, -4]) + r.choice([0, 0.1, 0.5]), r.choice([0, 4, 6, 9.5, None]), r.choice([0, 2, 5, 10, 12, None])) for _ in range(r.randrange(0, 40))] for p in range(60)}
    pages[60] = [(f"w{k}", 60.0 * k, 12.0 * (k // 9) + k % 3, 40.0, 10.0) for k in range(90)]
    pages[61], pages[62] = None, [("a", k, 0.9 * k, 1, 1) for k in range(50)]  # one line after another, each within reach of the item before
    pages = {p: i and [(t, *(None if v is None else float(v) for v in own)) for t, *own in i] for p, i in pages.items()}
    monkeypatch.setattr(lines, "AT_ONCE", 64)
    df = spark.createDataFrame([(p, "z", i) for p, i in pages.items()], "page long, kind string, own array<struct<text string, x double, y double, width double, height double>>").repartition(2)
    found = lines.lines_of_pages(df, "own")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for x in found.orderBy("page", "line").collect():
        assert x.kind == "z" and x.line == len(got.setdefault(x.page, []))
        got[x.page].append((x.items, round(x.y, 6), x.text))
    want = {}
    for p, items in pages.items():
        grouped = lines.group_lines(loose(items or []))
        want[p] = [(len(g), round(sum(i[2] for i in g) / len(g), 6), lines.readable(g)) for g in grouped]
    joined = spark.createDataFrame([(p, k, t) for p, own in want.items() for k, (_, _, t) in enumerate(own)], "page long, k int, text string")
    texts = {(x.page, x.k): x.text for x in joined.select("page", "k", lines.T.letters_joined(joined["text"]).alias("text")).collect()}
    assert got == {p: [(n, y, texts[p, k]) for k, (n, y, _) in enumerate(own)] for p, own in want.items() if own}


def test_documents_are_pages_without_a_shuffle(spark):
    from sedge.plans.texts import f13_page_lines

    assert "Exchange" not in f13_page_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
