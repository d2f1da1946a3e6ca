import random
import re

import pytest
from sedge.llm import decontaminate, personal, pieces
from sedge.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [None, "", " ", "a", "Hello  world\n x", "ünïcödé 漢字 \U0001f600​", "tab\tend ", "x" * 3000, "The the THE", "▁mark", "\x00\x01"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(MODEL)


def test_round_trip(spark, vocabulary):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, n_tokens string")
    coded = pieces.encode(df, vocabulary)
    got = {r.doc_id: r for r in pieces.decode(coded, vocabulary).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].text == (t or "").replace("▁", " ") and got[i].exact == ("▁" not in (t or "")) and got[i].n_tokens == len(got[i].ids)
    assert pieces.encode(df.limit(0), vocabulary).count() == 0


def test_best_score_against_plain_search(vocabulary):
    codec = pieces.Codec(vocabulary)
    score = {p: s for p, _, s in vocabulary.pieces}
    value = {i: s for _, i, s in vocabulary.pieces}
    r = random.Random(2)
    for _ in range(300):
        part = "▁" + "".join(r.choice("theandingréß漢z") for _ in range(r.randint(1, 14)))
        best = [0.0]
        for end in range(1, len(part) + 1):
            own = best[end - 1] + codec.byte_cost * len(part[end - 1].encode())
            best.append(max([own] + [best[a] + score[part[a:end]] for a in range(end) if part[a:end] in score]))
        assert abs(sum(value.get(i, codec.byte_cost) for i in codec.best(part)) - best[-1]) < 1e-6


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_edit_distance(spark):
    r = random.Random(4)
    letters = "abcdefgh ij"
    items = [(i, "".join(r.choice(letters) for _ in range(r.randint(20, 140)))) for i in range(15)] + [(90, None), (91, ""), (92, "short"), (92, "short")]
    docs = []
    for d in range(120):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 300)))
        for _ in range(r.randint(0, 2)):
            item = list(decontaminate.normal(r.choice(items)[1]))
            for _ in range(r.randint(0, 6)):
                if item:
                    k = r.randrange(len(item))
                    item[k : k + r.randint(0, 1)] = r.choice(["", "z", "ab"])
            at = r.randint(0, len(t))
            t = t[:at] + "".join(item).upper() + t[at:]
        docs.append((d, t, 7))
    docs += [(500, None, 7), (501, "", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t, _ in docs:
        for i, item in items:
            p, n = decontaminate.normal(item), decontaminate.normal(t)
            if p and (e := edit(p, n)) <= len(p) * 5 // 100:
                want.add((d, i))
                assert got[d, i].distance == e, (d, i)
                x = got[d, i]
                assert edit(p, n[x.start : x.end]) == e
    assert set(got) == want
    assert decontaminate.contaminated(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and personal.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_against_plain_patterns():
    r = random.Random(6)
    alphabet = ["1", "2", "9", "0", ".", "-", " ", "+", "(", ")", "@", "a", "_", "b.c", "d@e.fr", "192.168.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "é", "%"]
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert personal.base_spans(t) == plain(t), t


def test_discovery_and_redaction(spark):
    rows = [(i, f"word é card: 411111111111111{i % 10} and mail a{i}@ex.org end", "x") for i in range(0)]
    rows += [(i, f"é call +1 555 010 {1000 + i} now; of {2000 + i} sheep", "x") for i in range(60)]
    rows += [(100, "please call 555-010-77 now", "x"), (101, "a herd of 555-010-78 sheep", "x"), (102, None, "x"), (103, "", "x"), (104, "no data", "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = personal.find_personal(df)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [tuple(s) for s in by[100].spans] == [(12, 22, "phone")] and by[100].base == []
    assert by[101].spans == [] and by[102].spans == [] and by[103].spans == []
    text = {r.doc_id: r.t for r in df.join(got.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", personal.redacted(df.text, got.spans).alias("t")).collect()}
    assert text[5] == "é call [PHONE] now; of 2005 sheep" and text[100] == "please call [PHONE] now" and text[104] == "no data" and text[102] is None
    assert personal.find_personal(df.limit(0)).count() == 0


def test_encode_against_plain_search_over_whole_texts(spark, vocabulary):
    """Every row, repeated and of any length, has the ids that a plain pass over its parts gives."""
    r = random.Random(8)
    texts = [None, "", " ", "  ", "a  ", "▁", "x▁ y", "é" * 700, "漢字かな" * 300, "no\tspace\nhere"] + ["".join(r.choice("the and  ing é漢z,.") for _ in range(r.randint(0, 200))) for _ in range(80)]
    texts += texts[:30]
    codec = pieces.Codec(vocabulary)

    def plainly(t):
        return [i for p in re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁")) for i in codec.best(p)] if t else []

    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, exact string").repartition(3)
    got = {x.doc_id: x for x in pieces.encode(df, vocabulary).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k].ids == plainly(t) and got[k].n_tokens == len(got[k].ids) and got[k].exact == ("▁" not in (t or ""))


def test_few_remembered_parts(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    codec, text = pieces.Codec(vocabulary), "one two three four one two five six one seven " * 3
    assert codec.decode(codec.encode(text)) == text and codec.encode(text) == pieces.Codec(vocabulary).encode(text)
    assert len(codec.fresh) <= 3 and len(codec.older) <= 3


def test_same_ids_as_the_library_gives_for_scored_pieces(tmp_path):
    """A model of pieces with scores, written by hand: the automaton's ids score what the library's own search finds, and are the same but for ties."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    r = random.Random(12)
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = False
    names = ["▁", *"abcdeé"] + sorted({r.choice(["", "▁"]) + "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5))) for _ in range(150)})
    kinds = [("<unk>", 2, 0.0), ("<s>", 3, 0.0), ("</s>", 3, 0.0), *((f"<0x{b:02X}>", 6, 0.0) for b in range(256)), *((n, 1, -r.random() * 4 - 2 * (len(n) == 1)) for n in names)]
    for name, kind, score in kinds:
        model.pieces.add(piece=name, type=kind, score=score)
    path = f"{tmp_path}/own.model"
    open(path, "wb").write(model.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(pieces.Vocabulary.read(path))
    same = []
    for _ in range(400):
        t = "".join(r.choice("aabbcdeé  xß") for _ in range(r.randint(1, 60)))
        own, theirs = codec.encode(t), library.encode(t)
        same.append(own == theirs)  # of equal scores the library may take another
        assert abs(sum(kinds[i][2] for i in own) - sum(kinds[i][2] for i in theirs)) < 1e-4 and library.decode(own) == library.decode(theirs), t
        assert [i for i in own if 3 <= i < 259] == [i for i in theirs if 3 <= i < 259]
    assert sum(same) > 200


def plain_bootstrap(texts):
    """Spans beyond the base of each text, by rounds over plain sets."""
    every = [[(a, b, kind, v, [(s, x, y) for s, x, y in (("before", p, ""), ("after", "", q), ("both", p, q)) if (s == "after" or p) and (s == "before" or q)]) for a, b, kind, v, p, q in personal.mentions(t, personal.base_spans(t))] for t in texts]
    values, seed = {}, {}
    for _, _, kind, v, patterns in (m for d in every for m in d):
        for p in patterns:
            values.setdefault(p, set()).add(v)
            if kind:
                seed[p, v] = max(kind, seed.get((p, v), ""))
    known = {}
    while True:
        best = {}
        for p, vs in values.items():
            for kind in personal.KINDS:
                score = sum(1.0 if seed.get((p, v)) == kind else known[v][1] if (p, v) not in seed and known.get(v, ("",))[0] == kind else 0.0 for v in vs)
                if (w := score / (len(vs) + 1)) >= personal.BELIEF:
                    for v in vs:
                        if (p, v) not in seed and v not in known:
                            best[v] = max(best.get(v, (0, "")), (w, kind))
        if not best:
            return [[(a, b, known[v][0]) for a, b, kind, v, _ in d if kind is None and v in known] for d in every]
        known |= {v: (kind, w) for v, (w, kind) in best.items()}


def test_values_found_by_patterns_of_a_second_generation(spark):
    """Seeds stand after "ring", others after "ring" and before "please", others only before "please"."""
    texts = [f"é ring +1 555 010 {1000 + i} now" for i in range(1500)]
    texts += [f"so ring 9{i:03d}-{i} please" for i in range(60)] + [f"try {i} and 8{i:03d}-{i}, please" for i in range(1)] + [f"or of 7{i:03d} sheep" for i in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: [tuple(x) for x in r.spans if x not in r.base] for r in personal.find_personal(df).collect()}
    assert got == dict(enumerate(plain_bootstrap(texts)))
    assert [s[2] for s in got[1500]] == ["phone"] and [s[2] for s in got[1560]] == ["phone"] and not got[1570]
    assert "ring" not in texts[1560]


def test_bootstrapping_against_plain_rounds(spark):
    r = random.Random(11)
    texts = []
    for _ in range(400):
        t = []
        for _ in range(r.randint(1, 5)):
            w, v = r.choice([("call", f"+1 555 010 {r.randint(1000, 9999)}"), ("call", f"{r.randint(100, 999)}-{r.randint(10, 99)}"), ("mail", f"u{r.randint(0, 99)}@ex.org"), ("mail", f"u{r.randint(0, 30)}@ex"), ("of", str(r.randint(1000, 1300))), ("host", f"10.0.0.{r.randint(0, 255)}"), ("host", f"10.0.{r.randint(0, 9999)}")])
            t += [r.choice([w, w, w.upper() + ":", "x"]), v, r.choice(["now", "soon.", "(", ""])]
        texts.append(" ".join(t))
    texts += [f"call +1 555 01{i:05d} now" for i in range(6000)] + [f"Mail v{i}@ex.org soon" for i in range(900)]
    texts += [None, "", texts[0], "9" * 5000, "word" * 3000 + " call 55-5512"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    got = {x.doc_id: [tuple(s) for s in x.spans if s not in x.base] for x in personal.find_personal(df).collect()}
    want = dict(enumerate(plain_bootstrap([t or "" for t in texts])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and any(want.values())


def test_any_token_can_be_discovered(spark):
    """With no digits asked for, a pattern of many known values finds words; with the default it finds numbers alone."""
    rows = [(i, f"reach me at u{i}@ex.org today", "x") for i in range(80)] + [(100, "reach me at homebase today", "x"), (101, "reach me at 77-88123 today", "x"), (102, "come to homebase2 then", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    for digits, want in ((4, {101}), (0, {100, 101}), (9, set())):
        got = {r.doc_id: [tuple(x) for x in r.spans] for r in personal.find_personal(df, digits=digits).collect()}
        assert {d for d in (100, 101, 102) if got[d]} == want
        assert all(got[i] == [(12, 12 + len(f"u{i}@ex.org"), "email")] for i in range(80))
