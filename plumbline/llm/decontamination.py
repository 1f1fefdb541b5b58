"""Benchmark passages in documents, found by a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, map_rows
from plumbline.llm.terms import TERM, terms

PAIR_BITS = 22  # size of the table of adjacent words
SHARD_WORDS = 200_000  # item words in one automaton
PART_WORDS = 50_000  # longer items are cut into overlapping parts


class ItemAutomaton:
    """A suffix automaton of all items, over numbered words.

    A state stands for a set of word sequences that end at the same places of the
    items; ``link`` leads to the longest suffix that ends at more places. While a
    document is read, the state and the length of the longest match that ends at
    the present word are carried along, in amortised constant time a word.
    """

    def __init__(self, items: Iterable[tuple[int, bool, list[bytes]]], window: int):
        """``items``: number, whether it is a whole item, words. Parts of long items overlap by a window less one."""
        items = [x for x in items if x[2]]
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for _, _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.width = max(1, len(self.vocabulary))
        self.step: dict[int, int] = {}
        self.link, self.length, out = [-1], [0], [{}]
        numbered = [(n, whole, [self.vocabulary[w] for w in words]) for n, whole, words in items]
        for _, _, ids in numbered:
            last = 0
            for c in ids:
                last = self._extend(out, last, c)
        for state, to in enumerate(out):
            for c, target in to.items():
                self.step[state * self.width + c] = target
        self._mark(numbered)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, _, ids in numbered:
            if len(ids) > 1:
                row = np.array(ids, np.int64)
                self.pairs[self._slot(row[:-1], row[1:])] = True
        # No window is shorter, so shorter runs of known neighbours need no look.
        self.least = min([window, *(len(ids) for _, whole, ids in numbered if whole)])

    def _extend(self, out: list[dict[int, int]], last: int, c: int) -> int:
        link, length = self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            out.append(dict(out[q]))
            link[q] = clone
            while p >= 0 and out[p].get(c) == q:
                out[p][c] = clone
                p = link[p]
            return clone

        if c in out[last]:  # known from an earlier item
            q = out[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        out.append({})
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def _mark(self, numbered: list[tuple[int, bool, list[int]]]) -> None:
        """Where windows end: the state of the last ``window`` words, and short items by their whole length."""
        link, length, n = self.link, self.length, len(self.length)
        order = sorted(range(1, n), key=length.__getitem__)
        self.at = [-1] * n
        for s in order:
            if length[s] >= self.window:
                self.at[s] = s if length[link[s]] < self.window else self.at[link[s]]
        owners: dict[int, set[int]] = {}
        shorter: dict[int, dict[int, set[int]]] = {}
        for number, whole, ids in numbered:
            state = 0
            for i, c in enumerate(ids):
                state = self.step[state * self.width + c]
                if i + 1 >= self.window:
                    owners.setdefault(self.at[state], set()).add(number)
            if whole and len(ids) < self.window:
                shorter.setdefault(state, {}).setdefault(len(ids), set()).add(number)
        self.owners = {s: tuple(sorted(found)) for s, found in owners.items()}
        self.shorter = {s: sorted((size, tuple(sorted(found))) for size, found in by.items()) for s, by in shorter.items()}
        self.near = [0] * n  # the next state up the links, itself included, where a short item ends
        for s in order:
            self.near[s] = s if s in self.shorter else self.near[link[s]]

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a * self.width + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (key >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Stretches of words in which all neighbours may be neighbours in an item; every match lies within one."""
        if not words or not self.vocabulary:
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        joined = known[:-1] & known[1:]
        near = np.flatnonzero(joined)
        joined[near] = self.pairs[self._slot(ids[near], ids[near + 1])]
        ends = np.append(np.flatnonzero(~joined), len(ids) - 1) + 1
        starts = np.append(0, ends[:-1])
        for a, b in zip(*(x[(ends - starts >= self.least) & known[starts]].tolist() for x in (starts, ends))):
            yield a, ids[a:b].tolist()

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Hit stretches (first word, end) in order and apart, the items whose windows occur, and the longest match."""
        spans: list[list[int]] = []
        found: set[int] = set()
        longest = 0
        step, link, length, width, window = self.step, self.link, self.length, self.width, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for first, ids in self.runs(words):
            state = matched = 0
            for i, c in enumerate(ids, first + 1):
                to = step.get(state * width + c)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state * width + c)
                if to is None:
                    matched = 0
                    continue
                state = to
                matched += 1
                if matched >= window:
                    longest = max(longest, matched)
                    hit(i - window, i)
                    found.update(self.owners[self.at[state]])
                up = self.near[state]
                while up:
                    for size, items in self.shorter[up]:
                        if size <= matched:
                            longest = max(longest, size)
                            hit(i - size, i)
                            found.update(items)
                    up = self.near[link[up]]
        return spans, found, longest


def item_parts(items: DataFrame, item_col: str, text_col: str, window: int, part_words: int) -> DataFrame:
    """``item, whole, words, n``: the words of the items, long ones in parts that share ``window`` - 1 words."""

    def make():
        def cut(data: bytes | None) -> list[dict]:
            words = terms(data)
            if len(words) <= part_words:
                return [{"whole": True, "words": b" ".join(words), "n": len(words)}] if words else []
            parts = [words[a : a + part_words + window - 1] for a in range(0, len(words) - window + 1, part_words)]
            return [{"whole": False, "words": b" ".join(p), "n": len(p)} for p in parts]

        return lambda columns: {"item": columns[0], "parts": [cut(t) for t in columns[1]]}

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    listed = map_rows(rows, make, "item string, parts array<struct<whole: boolean, words: binary, n: int>>")
    return listed.select("item", F.explode("parts").alias("p")).select("item", "p.*")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_span: int = 10,
    max_coverage: float = 0.5,
    shard_words: int = SHARD_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, longest, rejected, clean_text``: one row for each document.

    A window is ``window`` consecutive words of an item, or a whole shorter item. A
    document word inside an occurrence of a window is hit; ``items`` (their ids as
    strings, sorted) are those with an occurring window; ``longest`` is the longest match that holds a
    window. ``clean_text`` lacks every hit stretch of ``max_span`` words or more; it
    is null and ``rejected`` true where over ``max_coverage`` of the words are hit.

    Documents are streamed through the automaton where they lie: no shuffle. The
    automaton is broadcast and holds at most about ``shard_words`` item words; a
    larger benchmark is dealt by hash over several, with one pass for each and the
    stretches found so far carried along in a written table.

    A null text has no words and stays null, an item without words has no window, a
    null item id is the item ``""``, items of one id are one item, repeated rows are
    judged alike, empty tables give no hits or no rows, other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    parts = scratch.table(item_parts(items, item_col, item_text_col, window, part_words).distinct(), "items")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    shard = F.pmod(F.xxhash64("item", "words"), F.lit(shards))
    flow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("data"),
        F.lit(None).cast("array<array<int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(0).alias("longest"),
    )
    id_type = dict(docs.dtypes)[id_col]
    for turn in range(shards):
        mine = [(r["item"] or "", r["whole"], bytes(r["words"]).split()) for r in parts.where(shard == turn).collect()]
        names = sorted({name for name, _, _ in mine})
        number = {name: i for i, name in enumerate(names)}
        shared = spark.sparkContext.broadcast((ItemAutomaton([(number[name], whole, words) for name, whole, words in mine], window), names))
        if turn < shards - 1:
            before, flow = flow, scratch.table(map_rows(flow, reader(shared), f"doc_id {id_type}, data binary, spans array<array<int>>, items array<string>, longest int"), "flow")
            scratch.drop(before)
        else:
            flow = map_rows(
                flow,
                judge(shared, max_span, max_coverage),
                f"doc_id {id_type}, n_words long, n_hit long, n_items long, items array<string>, longest int, rejected boolean, clean_text string",
            )
    return flow


def reader(shared):
    """Adds what one automaton finds to what the earlier ones found."""

    def make():
        automaton, names = shared.value

        def step(columns: list) -> dict:
            ids, data, spans, items, longest = columns
            for i, text in enumerate(data):
                more, found, far = automaton.matches(terms(text))
                spans[i] = union((spans[i] or []) + more)
                items[i] = sorted({*(items[i] or []), *(names[x] for x in found)})
                longest[i] = max(longest[i], far)
            return {"doc_id": ids, "data": data, "spans": spans, "items": items, "longest": longest}

        return step

    return make


def judge(shared, max_span: int, max_coverage: float):
    """The last automaton, and the verdict over all of them."""

    def make():
        read = reader(shared)()

        def step(columns: list) -> dict:
            done = read(columns)
            n_words = [len(terms(t)) for t in done["data"]]
            n_hit = [sum(b - a for a, b in found) for found in done["spans"]]
            rejected = [hit > max_coverage * n for hit, n in zip(n_hit, n_words)]
            return {
                "doc_id": done["doc_id"],
                "n_words": n_words,
                "n_hit": n_hit,
                "n_items": [len(x) for x in done["items"]],
                "items": done["items"],
                "longest": done["longest"],
                "rejected": rejected,
                "clean_text": [None if gone or t is None else without(t, found, max_span) for t, found, gone in zip(done["data"], done["spans"], rejected)],
            }

        return step

    return make


def union(spans: list[list[int]]) -> list[list[int]]:
    """Stretches in order; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(data: bytes, spans: list[list[int]], max_span: int) -> str:
    """The text without its long hit stretches, from their first letter to their last."""
    long = [(a, b) for a, b in spans if b - a >= max_span]
    if not long:
        return data.decode("utf-8", "replace")
    places = [m.span() for m in TERM.finditer(data.lower())]
    out, at = [], 0
    for a, b in long:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")
