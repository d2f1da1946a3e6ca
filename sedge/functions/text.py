"""Text measures and cuts on string columns; all JVM-side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII word characters or CJK ideographs."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_\\u4e00-\\u9fa5]+"), lambda t: t != "")


def length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def tokens_mixed(text: Column) -> Column:
    """A quarter of a token for each ASCII character, one for each other."""
    other = length_without(text, "[\\x00-\\x7F]")
    return F.ceil((F.length(text) - other) / 4) + other


def tokens_chat(text: Column) -> Column:
    """1.5 ideographs or four other characters to a token."""
    cjk = F.length(text) - length_without(text, "[\\u4e00-\\u9fff]")
    return F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 4)


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.trim(text)) / 400))


def preprocessed(text: Column) -> Column:
    """CRLF to LF, at most one blank line in a row, lines trimmed."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\n{3,}", "\n\n"), "\\n")
    return F.trim(F.array_join(F.transform(lines, lambda line: F.trim(line)), "\n"))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, content): windows of size characters, each overlap into the one before."""
    step = size - overlap
    last = F.when(F.length(text) <= size, F.lit(0)).otherwise(F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.substring(text, k * step + 1, F.lit(size)).alias("content")))


def three_slices(text: Column, budget: int) -> Column:
    """Head, middle and tail of a third of the budget each; a short text whole."""
    third = budget // 3
    middle = F.floor((F.length(text) - third) / 2).cast("int")
    cut = F.concat_ws("...", F.substring(text, 1, third), F.substring(text, middle + 1, F.lit(third)), F.substring(text, -third, third))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


# what follows takes text as it is; nfkc is the one function here that needs Python


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility form; null stays null."""

    def normal(t: pd.Series) -> pd.Series:
        return t.str.normalize("NFKC")

    return F.pandas_udf(normal, StringType())(text)


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def stripped_markup(text: Column, cap: int = 2000) -> Column:
    """Tags and control characters become spaces, white space collapses; what is longer than cap ends in an ellipsis."""
    plain = collapsed(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "[\\x00-\\x1F\\x7F]", " "))
    return F.when(F.length(plain) > cap, F.concat(F.substring(plain, 1, cap), F.lit("..."))).otherwise(plain)


def utf16_prefix(text: Column, units: int) -> Column:
    """At most so many UTF-16 units from the start, never half a character."""
    coded = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units)
    open_end = F.hex(F.substring(coded, -2, 1)).between("D8", "DB") & (F.octet_length(coded) == 2 * units)
    return F.decode(F.when(open_end, F.substring(coded, F.lit(1), F.lit(2 * units - 2))).otherwise(coded), "UTF-16BE")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


#: Words that graph lookups pass over.
STOP_WORDS = (
    "a", "an", "and", "are", "did", "do", "does", "for", "from", "how", "in", "is", "of", "on", "the", "to", "was", "were",
    "what", "when", "where", "which", "who", "why", "with", "什么", "哪些", "如何", "是否", "关于",
)


def graph_tokens(text: Column) -> Column:
    """Distinct lookup tokens of lower-case text: Latin runs of two or more characters; ideograph runs, their characters and pairs."""
    parts = matches(F.lower(text), "[a-z0-9][a-z0-9._:-]*|[\\u3400-\\u9fff]+")
    stop = F.array(*map(F.lit, STOP_WORDS))

    def of(m: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(m))
        single = F.filter(F.concat(F.array(m), F.transform(at, lambda i: F.substring(m, i, F.lit(1)))), lambda t: ~F.array_contains(stop, t))
        pairs = F.filter(F.transform(at, lambda i: F.substring(m, i, F.lit(2))), lambda t: F.length(t) == 2)
        latin = F.filter(F.array(m), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))
        return F.when(m.rlike("^[\\u3400-\\u9fff]"), F.concat(single, pairs)).otherwise(latin)

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def gram_tokens(text: Column) -> Column:
    """Words, characters and pairs of characters of each word, in lower case."""
    words = matches(F.lower(text), "[\\p{L}\\p{N}]+")

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(w))
        return F.concat(F.array(w), F.transform(at, lambda i: F.substring(w, i, F.lit(1))), F.filter(F.transform(at, lambda i: F.substring(w, i, F.lit(2))), lambda t: F.length(t) == 2))

    return F.flatten(F.transform(words, of))


def token_shares(text: Column) -> dict[str, Column]:
    """Counts of ideographs, Latin words, numbers and marks, and an estimate of tokens from them."""
    han, words = F.size(matches(text, "[\\u4e00-\\u9fff]")), F.size(matches(text, "[a-zA-Z]+"))
    numbers, marks = F.size(matches(text, "[0-9]+")), F.size(matches(text, "[^a-zA-Z0-9_\\s\\u4e00-\\u9fff]"))
    tokens = F.ceil(han * F.lit(0.7)) + F.ceil(words * F.lit(1.5)) + numbers + marks
    return {"han": han, "words": words, "numbers": numbers, "marks": marks, "tokens": F.greatest(F.lit(1), tokens)}


def characters(text: Column) -> Column:
    """The characters of a text, each once."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def shared_characters(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets from characters()."""
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both, F.size(x) + F.size(y) - both)


def character_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of characters."""
    return shared_characters(characters(a), characters(b))


def held_part(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 of the share of lengths if one holds the other, else null."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(a.contains(b) | b.contains(a), F.lit(0.8) * low / high)


def edit_part(a: Column, b: Column) -> Column:
    """0.7 of the edit similarity of two texts of which one at least has characters."""
    high = F.greatest(F.length(a), F.length(b))
    return F.when(high > 0, (F.lit(1.0) - F.levenshtein(a, b) / high) * 0.7)


def token_similarity(a: Column, b: Column, id_a: Column, id_b: Column) -> Column:
    """1 if equal, 0.8 of the share of lengths if one holds the other, else 0.7 edit similarity and 0.3 nearness of ids."""
    return F.coalesce(held_part(a, b), edit_part(a, b) + 0.3 / (1 + F.abs(id_a - id_b) * 0.001))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start, step, room = F.lit(2166136261).cast("long"), F.lit(16777619).cast("long"), F.lit((1 << 32) - 1).cast("long")
    return F.when(F.length(text) == 0, start).otherwise(F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * step).bitwiseAND(room)))


def slug(name: Column) -> Column:
    """A file name without its extension, lower case, everything but letters and digits as one dash."""
    return dashed(F.regexp_replace(F.lower(name), "\\.[a-z0-9]+$", ""))


def dashed(name: Column) -> Column:
    """A name in lower case, everything but letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def packed_paragraphs(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks: paragraphs (parted by blank lines) gathered until the next would pass size; each chunk but the first begins with
    the last ``overlap`` characters of the one before, or what follows the last sentence end in them if that lies past their half."""
    def bare(t):
        return F.regexp_replace(t, "^\\s+|\\s+$", "")

    parts = F.filter(F.transform(F.split(text, "\\n\\s*\\n"), bare), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        full = (F.length(s["open"]) + F.length(p) > size) & (s["open"] != "")
        tail = F.substring(s["open"], F.greatest(F.lit(1), F.length(s["open"]) - overlap + 1), F.lit(overlap))
        rest = F.regexp_replace(tail, "(?s)^.*[.!?。！？]", "")  # all of it where no sentence ends
        last = F.length(tail) - F.length(rest) - 1
        tail = F.when((F.length(s["open"]) > overlap) & (last > overlap * 0.5), rest).otherwise(tail)
        head = F.when(full, tail).otherwise(s["open"])
        return F.struct(F.when(full, F.array_append(s["done"], bare(s["open"]))).otherwise(s["done"]).alias("done"), F.concat(head, F.when(head != "", F.lit("\n\n")).otherwise(F.lit("")), p).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(bare(s["open"]) != "", F.array_append(s["done"], bare(s["open"]))).otherwise(s["done"]))


#: The name of an article without a heading, and signs that its title goes without.
UNNAMED, TITLE_SIGNS = "未命名文章", "🎯🚀📊🧠💬🔍🤖🕸️🛤️📚⚙️🗄️🔗🔄🦙🧩🪞🌲✨🔮"


def article_title(text: Column) -> Column:
    """The first heading of level 1 without signs, else UNNAMED."""
    heading = F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1)
    bare = F.regexp_replace(F.regexp_replace(heading, f"[{TITLE_SIGNS}]", ""), "^\\s+|\\s+$", "")
    return F.when(text.rlike("(?m)^#\\s+(.+)$"), bare).otherwise(F.lit(UNNAMED))


def article_description(text: Column) -> Column:
    """Up to 200 characters of the first line of prose: no heading, fence, table or list; empty without one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    prose = F.filter(lines, lambda x: (x != "") & ~x.rlike("^(#|```|\\||-|\\*)"))
    return F.when(F.size(prose) > 0, F.substring(F.get(prose, F.lit(0)), 1, 200)).otherwise("")


def file_slug(name: Column) -> Column:
    """A Markdown file's name in lower case without .md, underscores as dashes."""
    return F.replace(F.lower(F.regexp_replace(name, "\\.md", "")), F.lit("_"), F.lit("-"))


def token_kind(token: Column) -> Column:
    """special, english, chinese, number or punctuation, the first that all of a token is; what is mixed is special too."""
    # fixed values: the names of special tokens and the marks of punctuation
    kind = F.when(token.rlike(r"(?i)^\[(CLS|SEP|PAD|UNK|MASK)\]"), "special").when(token.rlike("^[a-zA-Z]+$"), "english").when(token.rlike("^[\\u4e00-\\u9fff]+$"), "chinese")
    return kind.when(token.rlike("^[0-9]+$"), "number").when(token.rlike(r"""^[.,!?:;()"'\-/\[\]{}]+$"""), "punctuation").otherwise("special")


def closed_json(text: Column) -> Column:
    """text with the brackets that it opens and does not close, arrays before objects; brackets inside strings are not told apart."""
    def missing(opened: str, closed: str) -> Column:
        return F.greatest(F.lit(0), length_without(text, f"[^\\{opened}]") - length_without(text, f"[^\\{closed}]"))

    return F.concat(text, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))


def letters_joined(text: Column) -> Column:
    """Line ends as \\n, three or more single letters in a row joined to a word, no white space at the ends of lines."""
    lines = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "[ \\t]+(?=\\n)", "")
    # a space between two single letters goes if a third stands next to them
    apart = "(?<=\\b[A-Za-z]) (?=[A-Za-z]\\b)"
    run = "(?:\\b[A-Za-z] ){2,}[A-Za-z]\\b"
    joined = F.aggregate(matches(lines, run), lines, lambda t, m: F.replace(t, m, F.regexp_replace(m, apart, "")))
    return F.trim(joined)
