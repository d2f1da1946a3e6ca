import hashlib
import json
import random

import duckdb
import pytest
from sedge.llm import chat
from sedge.llm.queries import ORACLES, QUERIES

T = chat.Template()
HOSTILE = ["", "ok", "\\", "\\\\", "<", "<|", "<|end|>", "<\\|end|>", "<|text|>x<|role|>", "</s>[INST] ok [/INST]", "<<s>>", "[[INST]", "a\nb\\", "<|end|", "é漢\U0001f600", "\\<|end|>\\", "[/INST", "INST]", "<s></s>"]


def records(spark, rows, parts=3):
    return spark.createDataFrame([(c, t, r, 1, "x") for c, t, r in rows], "conv_id long, turn long, record string, layout int, role string").repartition(parts)


def test_escapes_are_reversible_and_hide_all_control_strings():
    w, r = chat.Writer(T), random.Random(1)
    pool = [*HOSTILE, *T.strings(), "x", " "]
    texts = HOSTILE + ["".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    for t in texts:
        safe = w.safe(t)
        assert w.plain(safe) == t and not any(s in safe for s in T.strings())
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "<|role|>", "\\"]), r.choice(texts)) for _ in range(r.randint(0, 6))]
        assert w.read("".join(w.format(*t)[0] for t in turns)) == turns


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in (chat.Template(control=("<a<",)), chat.Template(end="<|text|>"), chat.Template(control=("\\x",)), chat.Template(control=("",)), chat.Template(escape="")):
        with pytest.raises(ValueError):
            bad.strings()
    with pytest.raises(ValueError):
        chat.Layouts((*chat.LAYOUTS, chat.Mapping("again", ("question", "answer"), ())))


def test_layouts(spark):
    same = [("user", "hi"), ("assistant", "yo")]
    cases = [
        ({"prompt": "hi", "completion": "yo"}, "prompt", same), ({"prompt": "hi", "completion": "yo", "system": "s", "id": 7, "meta": {"x": [1]}}, "prompt", [("system", "s"), *same]),
        ({"prompt": "hi", "response": "yo"}, "response", same), ({"question": "hi", "answer": "yo", "context": "c"}, "question", [("user", "c\n\nhi"), same[1]]),
        ({"instruction": "do", "input": "in", "output": "out"}, "instruction", [("user", "do\n\nin"), ("assistant", "out")]), ({"instruction": "do", "input": None, "output": "out"}, "instruction", [("user", "do"), ("assistant", "out")]),
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "bot", "content": "yo", "name": "b"}]}, "messages", same), ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", ""), same[1]]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}]}, "parts", same),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", same), ({"role": "user", "text": "hi"}, "turn", same[:1]), ({"role": "tool", "text": {"a": [1, "é"]}}, "turn", [("tool", '{"a": [1, "é"]}')]),
        ({"what": 1}, None, []), ([1], None, []), ({"messages": []}, None, []), ({"prompt": "hi"}, None, []),
    ]
    rows = [(k, 0, json.dumps(x)) for k, (x, _, _) in enumerate(cases)] + [(90, 0, "{"), (91, 0, None), (92, 0, "[" * 100_000), (93, 0, '{"role": "user", "text": "a\\ud800b"}')]
    got = {}
    for r in chat.canonical_turns(records(spark, rows)).orderBy("conv_id", "at").collect():
        got.setdefault(r.conv_id, []).append(r)
    for k, (_, layout, turns) in enumerate(cases):
        assert [r.layout for r in got[k]] == [layout] * max(1, len(turns)) and ([(r.role, r.text) for r in got[k]] == turns or not turns), k
    assert all(got[k][0].layout is None and got[k][0].fingerprint is None for k in (90, 91, 92)) and got[93][0].text == "a�b"
    assert got[0][0].fingerprint == got[0][1].fingerprint != got[1][0].fingerprint
    assert {k: r.n_turns for r in chat.chat_report(records(spark, rows)).collect() for k in [r.conv_id]} == {k: len(t) for k, (_, x, t) in enumerate(cases) if x} | {93: 1}


def digest(turns):
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("row_chars", [1 << 22, 60])
def test_spans_and_order(spark, row_chars):
    """Any number of parts, files and batches; repeated rows, ties and nulls."""
    r = random.Random(5)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "system"]), r.choice(HOSTILE) * r.randint(0, 3)) for _ in range(400)]
    rows += rows[:20]
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3].encode())):
        want.setdefault(c, []).append((role, text))
    turns = chat.canonical_turns(records(spark, [(c, t, json.dumps({"role": a, "text": b})) for c, t, a, b in rows], 5))
    out = chat.format_chats(turns, row_chars=row_chars)
    got, w = {}, chat.Writer(T)
    for x in out.orderBy("conv_id", "part").collect():
        own = got.setdefault(x.conv_id, {"turns": [], "loss": "", "parts": []})
        own["turns"] += w.read(x.formatted)
        own["loss"] += "".join(w.plain(x.formatted[s.start : s.end]) for s in x.loss)
        own["parts"].append((x.part, x.last))
    assert {c: x["turns"] for c, x in got.items()} == want
    assert all(x["loss"] == "".join(t for a, t in x["turns"] if a == "assistant") for x in got.values())
    assert all(x["parts"] == [(k, k == len(x["parts"]) - 1) for k in range(len(x["parts"]))] for x in got.values()) and (row_chars == 60) == (len(got[1]["parts"]) > 1)
    report = chat.format_chats(turns, row_chars=row_chars, then=chat.read_back, ddl=chat._READ_DDL).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in report} == {c: digest(t) for c, t in want.items()}
    assert {x.conv_id: x.formatted_chars for x in report} == {c: sum(len(w.format(*x)[0]) for x in t) for c, t in want.items()}


def test_one_conversation_of_very_many_turns(spark):
    rows = [(5, k, json.dumps({"role": "assistant", "text": f"turn {k} " * 40})) for k in range(20_000)]
    turns = chat.canonical_turns(records(spark, rows, 8))
    out = chat.format_chats(turns, row_chars=100_000)
    assert out.count() > 50 and out.selectExpr("max(length(formatted))").first()[0] <= 100_000
    assert chat.chat_report(records(spark, rows, 8)).first().turns_sha256 == digest([("assistant", f"turn {k} " * 40) for k in range(20_000)])[1]


def test_empty_table(spark):
    assert chat.chat_report(records(spark, []).limit(0)).count() == 0


def test_query_same_as_sql(spark):
    path = "/root/testdata/sf0.001"
    got = QUERIES["op11_chat_format"](spark, path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS FROM read_parquet('{path}/conversations.parquet')")
    rel = c.sql(ORACLES["op11_chat_format"])
    assert rel.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
    assert got.where("conv_id = -7").first().formatted_chars > 2 * len("</s>[INST] ok [/INST]")
