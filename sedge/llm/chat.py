"""Conversations of any layout in one format, with the spans that a loss is taken over.

Records are JSON. The fingerprint of a record is a hash of the nested paths of its fields; it selects a declarative mapping
that says where turns, roles and texts are. Fields that no mapping names count for nothing, so records may carry more.
The turns of a conversation are put in order and written with marks; whatever in a role or text looks like a
mark or another control string is escaped so that it can be read back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for each item of a list in a path.
ITEM = "*"


@dataclass(frozen=True)
class Turn:
    """One turn: its role as it is or the path of it, and paths of texts, joined by an empty line where they are there."""

    texts: tuple[str, ...]
    role: str = ""
    role_at: str = ""


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that records must have, those that they may have, and their turns.

    each: the path of a list (or "" for the record itself) that every turn is read for; paths in turns start there.
    A turn without any of its texts is left out, unless always. roles: other names of roles, with the canonical ones.
    """

    name: str
    required: tuple[str, ...]
    turns: tuple[Turn, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    always: bool = False
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> Iterator[int]:
        for n in range(len(self.optional) + 1):
            for more in itertools.combinations(self.optional, n):
                yield fingerprint({*self.required, *more})


#: Field names of common layouts, and other names of roles.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Mapping("turn", ("role",), (Turn(("text",), role_at="role"),), optional=("text",), always=True),
    Mapping("prompt", ("prompt", "completion"), (Turn(("system",), "system"), Turn(("prompt",), "user"), Turn(("completion",), "assistant")), optional=("system",)),
    Mapping("response", ("prompt", "response"), (Turn(("system",), "system"), Turn(("prompt",), "user"), Turn(("response",), "assistant")), optional=("system",)),
    Mapping("question", ("question", "answer"), (Turn(("context", "question"), "user"), Turn(("answer",), "assistant")), optional=("context",)),
    Mapping("instruction", ("instruction", "output"), (Turn(("system",), "system"), Turn(("instruction", "input"), "user"), Turn(("output",), "assistant")), optional=("input", "system")),
    Mapping("messages", ("messages/*/role",), (Turn(("content",), role_at="role"),), optional=("messages/*/content",), each="messages", always=True, roles=ROLES),
    Mapping("parts", ("messages/*/role", "messages/*/content/*/text"), (Turn(("content/*/text",), role_at="role"),), optional=("messages/*/content/*/type",), each="messages", always=True, roles=ROLES),
    Mapping("conversations", ("conversations/*/from",), (Turn(("value",), role_at="from"),), optional=("conversations/*/value",), each="conversations", always=True, roles=ROLES),
)


def step(key: str) -> str:
    """A field's name within a path."""
    return key.replace("~", "~0").replace("/", "~1").replace("*", "~2")


def field_paths(value, at: str = "") -> Iterator[str]:
    """Paths of all leaves; null fields are not there, and an empty list or record is a leaf."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from field_paths(v, f"{at}/{step(k)}" if at else step(k))
    elif isinstance(value, list) and value:
        for v in value:
            yield from field_paths(v, f"{at}/{ITEM}")
    elif value is not None:
        yield at


def fingerprint(paths: set[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "little", signed=True)


def found(value, path: str) -> list:
    """Values at a path, those of lists in order."""
    if not path:
        return [value]
    values = [value]
    for name in path.split("/"):
        if name == ITEM:
            values = [x for v in values if isinstance(v, list) for x in v]
        else:
            key = name.replace("~2", "*").replace("~1", "/").replace("~0", "~")
            values = [v[key] for v in values if isinstance(v, dict) and v.get(key) is not None]
    return values


class Layouts:
    def __init__(self, mappings: tuple[Mapping, ...]):
        self.named = {p for m in mappings for p in (*m.required, *m.optional)}
        self.known: dict[int, Mapping] = {}
        for m in mappings:
            for x in m.fingerprints():
                if self.known.setdefault(x, m) is not m:
                    raise ValueError(f"layouts {m.name} and {self.known[x].name} have the same fields")

    def turns(self, record: str | None) -> tuple[int | None, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout and (role, text) of each turn of a JSON record; without a layout no turns."""
        try:
            value = json.loads(record or "")
            mark = fingerprint({p for p in field_paths(value) if p in self.named})
        except (ValueError, RecursionError):
            return None, None, []
        mapping = self.known.get(mark)
        if mapping is None:
            return mark, None, []
        out, renamed = [], dict(mapping.roles)
        for item in found(value, f"{mapping.each}/{ITEM}" if mapping.each else ""):
            for turn in mapping.turns:
                texts = [written(x) for p in turn.texts for x in found(item, p)]
                if texts or mapping.always:
                    role = turn.role or "".join(map(written, found(item, turn.role_at)))
                    out.append((renamed.get(role, role), ("\n\n" if len(turn.texts) > 1 else "").join(texts)))
        return mark, mapping.name, out


def written(value) -> str:
    """A text as it is, other values as JSON; half of a surrogate pair, which no text can hold, becomes U+FFFD."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass(frozen=True)
class Template:
    """Marks before a role, between role and text, and after a text; further strings that no text may hold as they are.

    An escape goes after the first character of each control string in a role or text, and escapes are doubled. The first
    character of a control string stands nowhere else in any of them, so that none overlaps another or a mark.
    """

    role: str = "<|role|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)

    def strings(self) -> tuple[str, ...]:
        every = (self.role, self.text, self.end, *self.control)
        firsts = {s[:1] for s in every} | {self.escape}
        if len(self.escape) != 1 or self.escape in "".join(s[:1] for s in every) or any(not s or firsts & set(s[1:]) for s in every):
            raise ValueError("control strings start with characters that stand nowhere else in them, other than the escape")
        if len({self.role, self.text, self.end}) < 3:
            raise ValueError("the three marks differ")
        return every


class Writer:
    def __init__(self, template: Template):
        self.t = template
        own = "|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in template.strings())
        self.special = re.compile(f"{re.escape(template.escape)}|{own}")
        self.escaped = re.compile(f"{re.escape(template.escape)}(.)", re.DOTALL)
        self.turn = re.compile(f"{re.escape(template.role)}(.*?){re.escape(template.text)}(.*?){re.escape(template.end)}", re.DOTALL)

    def safe(self, text: str) -> str:
        return self.special.sub(lambda m: m[0] + self.t.escape, text)

    def plain(self, text: str) -> str:
        """What safe() made of a text, as it was: of each escape and the character after it the latter stays."""
        return self.escaped.sub(lambda m: m[1], text)

    def format(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn as text, and where in it the loss is taken (nowhere: 0, 0)."""
        head, body = f"{self.t.role}{self.safe(role)}{self.t.text}", self.safe(text)
        loss = (len(head), len(head) + len(body)) if role in self.t.trained else (0, 0)
        return f"{head}{body}{self.t.end}", *loss

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        return [(self.plain(a), self.plain(b)) for a, b in self.turn.findall(formatted)]


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int32()), ("fingerprint", pa.int64()), ("layout", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURNS_DDL = "conv_id long, turn long, at int, fingerprint long, layout string, role string, text string"
#: Turns in one Arrow batch, and characters of a formatted row: a longer conversation goes on in further rows.
TURNS, ROW_CHARS = 1_000, 1 << 22


def canonical_turns(records: DataFrame, record_col: str = "record", id_col: str = "conv_id", order_col: str = "turn", mappings: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, at, fingerprint, layout, role, text of each turn of each JSON record.

    at: the turn's number within its record. A record of unknown fields, or one that is null or no JSON, gives one
    row with a null layout, role and text (no fingerprint if it is no JSON or nested too deep). A record whose lists are
    empty has no turns. Other values than texts are written as JSON; null fields are not there. Repeated records are each
    read; null ids stay null. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    Layouts(mappings)  # layouts that can't be told apart are an error here

    def run(batches):
        layouts = Layouts(mappings)
        for batch in batches:
            rows = []
            for who, order, record in zip(batch["id"].to_pylist(), batch["place"].to_pylist(), batch["record"].to_pylist()):
                mark, layout, turns = layouts.turns(record)
                rows += [(who, order, k, mark, layout, *t) for k, t in enumerate(turns)] if layout else [(who, order, 0, mark, None, None, None)]
                if len(rows) >= TURNS:
                    yield _batch(_TURNS, rows)
                    rows = []
            yield _batch(_TURNS, rows)

    thin = records.select(F.col(id_col).cast("long").alias("id"), F.col(order_col).cast("long").alias("place"), F.col(record_col).alias("record"))
    return thin.mapInArrow(run, _TURNS_DDL)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_OUT_DDL = "conv_id long, part int, last boolean, formatted string, loss array<struct<start:long,end:long>>"


def format_chats(turns: DataFrame, template: Template = Template(), row_chars: int = ROW_CHARS, then=None, ddl: str = _OUT_DDL) -> DataFrame:
    """conv_id, part, last, formatted, loss: each conversation as text, with the spans of it that the loss is taken over.

    turns are those of canonical_turns(); rows without a layout are left out. A conversation's turns go by turn, then by
    their place in a record, then by role and text, nulls last; rows of a null id are one conversation. Null texts and
    roles are empty. loss: starts and ends (exclusive) of the trained roles' texts, in characters of this
    row's text, escapes included. Rows of a conversation follow one another; one of over ``row_chars`` characters is cut between turns into
    parts from 0, so that no row holds an unbounded group: turns are streamed in order, and only one turn and one row
    are in memory. ``then`` makes rows of ``ddl`` of the batches before they leave the task.
    An empty table gives an empty result.
    """
    template.strings()

    def run(batches):
        writer, rows, held = Writer(template), [], 0
        now, part, texts, loss, size = None, 0, [], [], 0

        def closed(last: bool):
            return (now[0], part, last, "".join(texts), loss)

        for batch in batches:
            for who, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                own, start, end = writer.format(role or "", text or "")
                new = now is None or now[0] != who
                if now is not None and (new or size + len(own) > row_chars):
                    rows.append(closed(new))
                    held += size
                    part, texts, loss, size = (0 if new else part + 1), [], [], 0
                    if held > row_chars or len(rows) >= TURNS:
                        yield _batch(_OUT, rows)
                        rows, held = [], 0
                now = (who,)
                if role in template.trained:
                    loss.append({"start": size + start, "end": size + end})
                texts.append(own)
                size += len(own)
        if now is not None:
            rows.append(closed(True))
        yield _batch(_OUT, rows)

    order = [F.asc_nulls_last(c) for c in ("conv_id", "turn", "at", "role", "text")]
    dealt = turns.where("layout IS NOT NULL").select("conv_id", "turn", "at", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(run if then is None else lambda b: then(run(b)), ddl)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches, template: Template = Template()):
    """Digests of what the rows of format_chats() say, a row for each conversation, read from the text and its spans.

    The digests run along the parts, so a conversation of any length takes the memory of one part.
    """
    writer, rows = Writer(template), []
    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for batch in batches:
        for who, last, text, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "last", "formatted", "loss"))):
            for role, said in writer.read(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for s in spans:
                trained = writer.plain(text[s["start"] : s["end"]])
                loss.update(trained.encode())
                chars += len(trained)
            size += len(text)
            if last:
                rows.append((who, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        yield _batch(_READ, rows)
        rows = []


def chat_report(records: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its formatted text.

    turns_sha256: of role, \\n, text, \\n of each turn; loss_sha256: of all text under the loss mask, unescaped, without anything between.
    """
    return format_chats(canonical_turns(records, **columns), template, then=lambda b: read_back(b, template), ddl=_READ_DDL)
