"""Texts as sub-words: greedy longest or best matches in a trie, and merges in the order of their ranks."""

from __future__ import annotations

import base64
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a vocabulary that is sent with the tasks at most.
MOST_ENTRIES = 1_000_000
#: Distinct words that a task remembers, and tokens and merges of them; it then starts anew.
REMEMBERED, REMEMBERED_STEPS = 100_000, 2_000_000
#: Distinct words that a task counts at once, and distinct parts of texts whose results it keeps, with so many characters in all; it then starts anew.
DISTINCT, DISTINCT_CHARACTERS = 300_000, 6_000_000
#: Characters of texts whose results are handed on at once.
PIECE = 1 << 20


def runs_of(sizes: Sequence[int], at_most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that have at most so many characters, or are one text; sizes: characters of each."""
    start = size = 0
    for k, own in enumerate(sizes):
        if k > start and size + own > at_most:
            yield start, k
            start, size = k, 0
        size += own
    if start < len(sizes):
        yield start, len(sizes)


def in_pieces(texts: Sequence[str | None], at_most: int) -> Iterator[tuple[int, int]]:
    """runs_of() the texts' sizes."""
    yield from runs_of([len(t or "") for t in texts], at_most)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank on each line. The rank is the token's id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MOST_ENTRIES:
        raise ValueError("the vocabulary is too large to be sent with the tasks")
    return ranks


@dataclass(frozen=True)
class Entry:
    token: str
    id: int
    rank: int
    frequency: int

    def score(self) -> float:
        """What the frequency adds, and what the rank does."""
        return math.log(self.frequency + 1) / 10 * 0.7 + 1 / (self.rank + 1) * 0.3


#: Size of the table that pairs of characters are hashed to.
PAIRS = 1 << 20
_NONE: dict[str, int] = {}


def _pair(x, y):
    return (x * 40_503 + y) % PAIRS


class Trie:
    """A trie in arrays: children of a node by character, the entry that ends at a node, and of the entries on the way to it how many they are and the first of the highest score."""

    def __init__(self, entries: list[Entry]):
        if len(entries) > MOST_ENTRIES:
            raise ValueError("the vocabulary is too large to be sent with the tasks")
        self.step: dict[tuple[int, str], int] = {}
        self.entry: list[Entry | None] = [None]
        self.score: list[float] = [0.0]
        for e in entries:
            node = 0
            for c in e.token:
                nxt = self.step.get((node, c))
                if nxt is None:
                    nxt = self.step[node, c] = len(self.entry)
                    self.entry.append(None)
                    self.score.append(0.0)
                node = nxt
            if node:
                self.entry[node], self.score[node] = e, e.score()
        self.many, self.top = [0] * len(self.entry), [0] * len(self.entry)
        for (parent, _), node in self.step.items():  # parents come before their children
            own = self.entry[node] is not None
            self.many[node] = self.many[parent] + own
            self.top[node] = node if own and (not self.many[parent] or self.score[node] > self.score[self.top[parent]]) else self.top[parent]
        self.joined = np.zeros(PAIRS, bool)
        for x, y in {xy for e in entries for xy in zip(e.token, e.token[1:])}:
            self.joined[_pair(ord(x), ord(y))] = True
        self.children: list[dict[str, int]] = [_NONE] * len(self.entry)  # leaves share one
        for (parent, c), node in self.step.items():
            if self.children[parent] is _NONE:
                self.children[parent] = {}
            self.children[parent][c] = node
        self.known: dict[Callable, dict[str, object]] = {}
        self.characters = 0

    def parts(self, text: str) -> list[str]:
        """The text cut between characters that stand side by side in no entry: no entry reaches over a cut, so split() gives the same of the parts, one after another, as of the text.
        Pairs of characters are looked up by a hash, so some that could be cut are not."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        cuts = (np.flatnonzero(~self.joined[_pair(codes[:-1], codes[1:])]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []

    def by_part(self, text: str, of: Callable[[list], object]) -> list:
        """What a function makes of split()'s rows of each part of the text. Results of distinct parts are kept, DISTINCT at a time."""
        out, known = [], self.known.setdefault(of, {})
        for part in self.parts(text):
            got = known.get(part)
            if got is None:
                got = of(list(self.split(part)))
                if len(known) >= DISTINCT or self.characters + len(part) > DISTINCT_CHARACTERS:
                    known.clear()
                    self.characters = 0
                known[part] = got
                self.characters += len(part)
            out.append(got)
        return out

    def candidates(self, text: str, at: int) -> list[int]:
        """Nodes of all entries that start at a place, shortest first."""
        node, found = 0, []
        for k in range(at, len(text)):
            nxt = self.step.get((node, text[k]))
            if nxt is None:
                break
            node = nxt
            if self.entry[node]:
                found.append(node)
        return found

    def best(self, found: list[int]) -> int:
        """The first of the highest score."""
        return max(found, key=lambda n: self.score[n])

    def split(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        """(token, id, candidates, kind) from the left: the best entry at each place, else the character by itself with its code.

        kind: merge (several entries start there), split (one does) or fallback.
        """
        children, at, n = self.children, 0, len(text)
        while at < n:
            node, k = 0, at
            while k < n and (nxt := children[node].get(text[k])) is not None:
                node, k = nxt, k + 1
            many = self.many[node]
            if many:
                e = self.entry[self.top[node]]
                yield e.token, e.id, many, "merge" if many > 1 else "split"
                at += len(e.token)
            else:
                yield text[at], ord(text[at]), 0, "fallback"
                at += 1

    def merges(self, text: str) -> Iterator[tuple[str, str, str, int]]:
        """(left, right, merged, rank) for each place with several entries: the two shortest, what was taken, and its rank."""
        at = 0
        while at < len(text):
            found = self.candidates(text, at)
            if not found:
                at += 1
                continue
            e = self.entry[self.best(found)]
            if len(found) > 1:
                yield self.entry[found[0]].token, self.entry[found[1]].token, e.token, e.rank
            at += len(e.token)


def merge_steps(word: bytes, ranks: dict[bytes, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(id, start, end) of the tokens of a word, and (rank, start, middle, end) of each merge in order.

    Parts are a linked list, pairs of neighbours a heap of their ranks: the lowest rank merges first, of equal ones the leftmost. A
    pair that has changed meanwhile is met again in the heap and passed over, so a word of n bytes takes n log n steps.
    """
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n:
            rank = ranks.get(word[a : end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, end[a], end[b]))

    for a in range(n - 1):
        offer(a)
    steps = []
    while heap:
        rank, a, middle, stop = heapq.heappop(heap)
        if not alive[a] or end[a] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        steps.append((rank, a, middle, stop))
        alive[middle], end[a], after[a] = False, stop, after[middle]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [(ranks[word[a : end[a]]], a, end[a]) for a in range(n) if alive[a]], steps


#: Bytes of words whose pairs are looked through for each merge; longer ones take merge_steps().
SHORT = 64


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the tokens that merge_steps() gives."""
    if len(word) > SHORT:
        return [i for i, _, _ in merge_steps(word, ranks)[0]]
    none = math.inf
    parts = [word[k : k + 1] for k in range(len(word))]
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) != none:
        k = pairs.index(low)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
        if k:
            pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
    return [ranks[x] for x in parts]


def _checked(ranks: dict[bytes, int]) -> dict[bytes, int]:
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or len(ranks) > MOST_ENTRIES:
        raise ValueError("the vocabulary needs all single bytes, and to be small enough to be sent with the tasks")
    return ranks


def token_counts(texts: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """id, n: how often each id is a token of the texts as capture_merges() has them. Words are counted first, DISTINCT ones of a task at a time, and each is merged once."""
    sent = texts.sparkSession.sparkContext.broadcast(_checked(ranks))  # bounded: MOST_ENTRIES

    def count(batches):
        import regex

        words, seen = regex.compile(pattern), Counter()
        for batch in batches:
            for text in batch["text"].tolist():
                seen.update(words.findall(text or ""))
                if len(seen) >= DISTINCT:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    def merge(batches):
        often = Counter()
        for batch in batches:
            for w, n in zip(batch["word"].tolist(), batch["n"].tolist()):
                for i in merged_ids(w.encode(), sent.value):
                    often[i] += n
        yield pd.DataFrame({"id": list(often), "n": list(often.values())})

    words = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInPandas(merge, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def capture_merges(texts: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str = "text") -> DataFrame:
    """The id; ids, starts, ends of a text's tokens; ranks, lefts, middles, rights of its merges, word by word in the order of the text.

    Words are the matches of ``pattern`` (a regular expression of the regex package); offsets are bytes of the text's UTF-8. Each word is merged by merge_steps(); every single byte must
    be in the vocabulary. Null and empty texts have no tokens; repeated rows are each done. Distinct words are remembered, REMEMBERED at a time.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_checked(ranks))  # bounded: MOST_ENTRIES
    kind = texts.schema[id_col].dataType.simpleString()
    columns = ("ids", "starts", "ends", "ranks", "lefts", "middles", "rights")

    def run(batches):
        import regex

        words, known, steps = regex.compile(pattern), {}, 0

        def solve(w: str) -> tuple:
            own = w.encode()
            return len(own), *(np.array(x, np.int32).reshape(-1, n) for x, n in zip(merge_steps(own, sent.value), (3, 4)))

        for batch in batches:
            ids, said_texts = batch["id"], batch["text"].tolist()
            for first, last in in_pieces(said_texts, PIECE):  # seven arrays of a whole batch would be many times its texts
                out = [[] for _ in columns]
                for text in said_texts[first:last]:
                    solved = []
                    for w in words.findall(text or ""):
                        got = known.get(w)
                        if got is None:
                            got = solve(w)
                            own = len(got[1]) + len(got[2])
                            if len(known) >= REMEMBERED or steps + own > REMEMBERED_STEPS:
                                known.clear()
                                steps = 0
                            known[w], steps = got, steps + own
                        solved.append(got)
                    size = np.fromiter((x[0] for x in solved), np.int64, len(solved))
                    starts = (np.cumsum(size) - size).astype(np.int32)
                    k = 0
                    for side in (1, 2):
                        rows = np.concatenate([np.zeros((0, 2 + side), np.int32), *(x[side] for x in solved)])
                        moved = np.repeat(starts, np.fromiter((len(x[side]) for x in solved), np.int64, len(solved)))
                        for c in range(2 + side):
                            out[k].append(rows[:, c] + moved if c else rows[:, 0].copy())
                            k += 1
                yield pd.DataFrame({id_col: ids.iloc[first:last].to_numpy(), **dict(zip(columns, out))})

    thin = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return thin.mapInPandas(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} array<int>" for c in columns))


def waterfall(texts: DataFrame, entries: list[Entry], id_col: str, text_col: str = "text", then: Callable[[Trie, str], tuple] | None = None, ddl: str = "tokens array<string>, ids array<int>, candidates array<int>, kinds array<string>") -> DataFrame:
    """The id and, of each text, its sub-words by Trie.split(): tokens, ids, candidates, kinds; or what ``then`` makes of trie and text, as ``ddl``.

    Null and empty texts have none; texts are gone through whole, from the left.
    """
    sent = texts.sparkSession.sparkContext.broadcast(entries)  # bounded: MOST_ENTRIES
    kind = texts.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in ddl.split(", ")]

    def split(trie: Trie, text: str) -> tuple:
        rows = list(trie.split(text))
        return tuple([r[k] for r in rows] for k in range(4))

    def run(batches):
        trie = Trie(sent.value)
        for batch in batches:
            ids, said = batch["id"], batch["text"].tolist()
            for first, last in in_pieces(said, PIECE):
                rows = [(then or split)(trie, t or "") for t in said[first:last]]
                yield pd.DataFrame({id_col: ids.iloc[first:last].to_numpy(), **{c: [r[k] for r in rows] for k, c in enumerate(names)}})

    thin = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return thin.mapInPandas(run, f"`{id_col}` {kind}, {ddl}")
