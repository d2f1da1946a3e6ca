"""Personal data: patterns of known shapes, and identifiers found by bootstrapping from the words around others.

Known shapes (email, ip, card, phone) are seeds. The words before and after a mention, each alone and both together,
are its lexical patterns; values and patterns form a graph that Spark scores round by round. A pattern's weight for a kind is
the score of its distinct believed values of that kind over all its distinct values and one; a pattern of BELIEF or more is
trusted, and a number-like or mail-like token that no shape took is believed with the kind and weight of its best
trusted pattern. Believed values count as seeds in the next round, so they make further patterns trusted, until
a round believes nothing new.
"""

from __future__ import annotations

import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: Characters of an address before its @, and the shapes of the other kinds. A run of digits is tried from its first only.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A token that could be an identifier of an unknown shape.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'|*#$&%"
_SPACE = frozenset(" \t\n\r\x0b\x0c")
#: Weight from which a pattern is trusted. As one is added to its values, no pattern of under LEAST values is.
BELIEF = 0.9
LEAST = 9
#: Digits of a token without an @ that patterns may discover.
DIGITS = 4


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str):
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            past = m.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed. Leftmost and not overlapping for each kind."""
    out = [(*s, "email") for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def word_before(text: str, at: int) -> str:
    """The last word that ends at or before at, lower case, without marks at its edges; words of marks only are passed over."""
    while at:
        while at and text[at - 1] in _SPACE:
            at -= 1
        stop = at
        while at and text[at - 1] not in _SPACE:
            at -= 1
        if word := text[at:stop].strip(_EDGE).lower():
            return word
    return ""


def word_after(text: str, at: int) -> str:
    """The first word that starts at or after at, likewise."""
    while at < len(text):
        while at < len(text) and text[at] in _SPACE:
            at += 1
        start = at
        while at < len(text) and text[at] not in _SPACE:
            at += 1
        if word := text[start:at].strip(_EDGE).lower():
            return word
    return ""


def mentions(text: str, spans: list[tuple[int, int, str]], digits: int = DIGITS) -> list[tuple[int, int, str | None, str, str, str]]:
    """(start, end, kind or None, value, word before, word after) of seeds and of tokens of unknown shape.

    A token of unknown shape has ``digits`` digits or an @, is taken without marks at its edges and overlaps no seed.
    """
    found: list[tuple[int, int, str | None]] = list(spans)
    if not digits or _DIGIT.search(text) or "@" in text:
        taken, k, reach = sorted((a, b) for a, b, _ in spans), 0, 0
        for m in _TOKEN.finditer(text):
            token = m[0]
            if "@" not in token and sum("0" <= c <= "9" for c in token) < digits:
                continue
            start = m.start() + len(token) - len(token.lstrip(_EDGE))
            end = m.end() - len(token) + len(token.rstrip(_EDGE))
            while k < len(taken) and taken[k][0] < end:  # seeds that start before the token's end; reach: their furthest end
                reach = max(reach, taken[k][1])
                k += 1
            if start < end and reach <= start:
                found.append((start, end, None))
    return [(start, end, kind, text[start:end].lower(), word_before(text, start), word_after(text, end)) for start, end, kind in found]


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("row", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
    ("mentions", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string())]))),
])
_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"
_DDL = f"doc_id long, row long, base {_SPANS}, mentions array<struct<start:bigint,end:bigint,kind:string,value:string,left:string,right:string>>"


def _scanned(batches, digits: int):
    for batch in batches:
        base, around = [], []
        for t in batch["text"]:
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            around.append([{"start": a, "end": b, "kind": k, "value": v, "left": p, "right": q} for a, b, k, v, p, q in mentions(text, spans, digits)])
        yield pa.record_batch([batch["doc_id"], batch["row"], pa.array(base, _SCHEMA.field(2).type), pa.array(around, _SCHEMA.field(3).type)], schema=_SCHEMA)


def believed(found: DataFrame) -> DataFrame:
    """value, kind of the unknown values that bootstrapping reaches; found has kind (null: unknown), value, left, right.

    Of equal weights the kind that is later in the alphabet counts. Each round reads pairs of a pattern and a value, combined before they are
    shuffled, so a pattern or value may hold any share of them; the driver sees only if something is new.
    """
    blank = F.lit("")

    def pattern(side: str, left, right):
        return F.struct(F.lit(side).alias("side"), left.alias("left"), right.alias("right"))

    sides = F.array(pattern("before", F.col("left"), blank), pattern("after", blank, F.col("right")), pattern("both", F.col("left"), F.col("right")))
    named = F.filter(sides, lambda p: ((p["side"] == "after") | (p["left"] != "")) & ((p["side"] == "before") | (p["right"] != "")))
    pairs = found.select("value", "kind", F.explode(named).alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    # only patterns that could be trusted and have a value to find
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("values"), F.count_if(F.col("seed").isNull()).alias("unknown"))
    sizes = sizes.where((F.col("values") >= LEAST) & (F.col("unknown") > 0)).select("pattern", "values")
    pairs = checkpointed(pairs.join(sizes, "pattern"))
    weight = (F.sum("score") / (F.first("values") + 1)).alias("weight")
    seeds = pairs.where("seed IS NOT NULL").select("pattern", "values", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    unknown = pairs.where("seed IS NULL").select("pattern", "value", "values")
    known = None
    while True:
        support = seeds if known is None else seeds.unionByName(unknown.join(known, "value").select("pattern", "values", "kind", "score"))
        trusted = support.groupBy("pattern", "kind").agg(weight).where(F.col("weight") >= BELIEF)
        reached = unknown.join(trusted, "pattern").groupBy("value").agg(F.max(F.struct("weight", "kind")).alias("best"))
        fresh = reached.select("value", F.col("best.kind").alias("kind"), F.col("best.weight").alias("score"))
        if known is not None:
            fresh = fresh.join(known, "value", "left_anti")
        fresh = checkpointed(fresh)
        if fresh.isEmpty():
            return fresh.select("value", "kind") if known is None else known.select("value", "kind")
        known = fresh if known is None else checkpointed(known.unionByName(fresh))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind) by start, then kind as in KINDS.

    Patterns may discover tokens that have an @ or at least ``digits`` digits; 0: any token, as many candidates as words.

    base has the known shapes, spans those and the discovered ones. Offsets are code points, the end
    exclusive. One row for each row of docs, repeated ones and null ids too. A value counts once for a pattern, however often and
    in however many rows it stands there. Null and empty texts have empty arrays; texts and words of any length are taken whole; an
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    scanned = checkpointed(thin.mapInArrow(lambda it: _scanned(it, digits), _DDL))
    found = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    new = found.where("kind IS NULL").drop("kind").join(believed(found), "value")
    extra = new.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra"))
    order = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    both = F.concat("base", F.coalesce("extra", F.array().cast(_SPANS)))
    ranked = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.join(extra, "row", "left").select("doc_id", "base", spans.alias("spans"))


def written(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text, spans) -> F.Column:
    """text with [KIND] in the place of each span; of overlapping ones the first counts, up to the furthest end."""
    start = F.lit(0).cast("long")
    state = F.struct(F.lit("").alias("out"), start.alias("at"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        gap = F.when(fresh, F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], gap).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(1 << 30))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
