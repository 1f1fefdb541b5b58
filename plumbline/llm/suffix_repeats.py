"""Quality rules on repetition: suffix arrays of words, their LCP intervals and verdicts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows

# What separates words, and what counts as a symbol.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BATCH_WORDS = 60_000


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of ``codes`` by prefix doubling, with the ranks of every level.

    ``ranks[l][i]`` orders the substrings of length 2**l that start at ``i``; it
    ends as soon as all ranks differ. Callers close every text with a code of its
    own, so no substring that matches elsewhere runs past a text's end.
    """
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n and rank[order[-1]] != n - 1 and step < n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and at ``b``, by binary lifting."""
    n = len(ranks[0])
    a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[level], 1 << level
        same = (a < n) & (b < n)
        same[same] = rank[a[same]] == rank[b[same]]
        a[same] += step
        b[same] += step
        size[same] += step
    return size


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position the longest substring from there that occurs again (overlaps allowed).

    It is the value of the innermost LCP interval around the position's suffix:
    the larger of its two neighbouring LCP values in suffix order.
    """
    if len(codes) < 2:
        return np.zeros(len(codes), np.int64)
    order, ranks = suffix_array(codes)
    lcp = common_prefix(ranks, order[:-1], order[1:])
    best = np.zeros(len(codes), np.int64)
    best[order[1:]] = lcp
    best[order[:-1]] = np.maximum(best[order[:-1]], lcp)
    return best


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Marks the positions inside the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:n]) > 0


def word_codes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words with a closing code after each text, and the text of each code.

    The text's number is part of a word's code: equal words of different texts never match.
    """
    ids: dict[str, int] = {}
    flat = [ids.setdefault(w, len(ids)) for words in texts for w in words]
    lengths = np.array([len(w) for w in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    codes = np.full(int(lengths.sum()) + len(texts), -1, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = flat
    return owner * (len(ids) + 1) + codes + 1, owner


def base_counts(text: str, words: list[str]) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of one text."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup


def measure(min_repeat: int) -> Callable[[], Callable[[list], dict]]:
    """The measuring step of a task; see ``repetition`` for the columns."""

    def of_batch(texts: list[str], words: list[list[str]]) -> tuple[list, list, list, list]:
        codes, owner = word_codes(words)
        best = longest_repeats(codes)
        n, docs = len(codes), len(texts)
        three = np.flatnonzero(best >= 3)
        short = covered(three, np.full(len(three), 3), n)
        # A span is left-maximal unless the position before already reaches as far or farther.
        start = np.flatnonzero(best >= min_repeat)
        start = start[(start == 0) | (best[start - 1] <= best[start]) | (owner[start - 1] != owner[start])]
        long = covered(start, best[start], n)
        total = lambda marks: np.bincount(owner, marks, docs).astype(np.int64).tolist()
        longest = np.zeros(docs, np.int64)
        np.maximum.at(longest, owner, best)
        return total(short), total(long), np.bincount(owner[start], minlength=docs).tolist(), longest.tolist()

    def make():
        def step(columns: list) -> dict:
            texts = [t or "" for t in columns[-1]]
            words = [WORD.findall(t) for t in texts]
            out = {"n_words": [len(w) for w in words]}
            base = [base_counts(t, w) for t, w in zip(texts, words)]
            out["word_chars"], out["n_symbols"], out["n_dup_lines"] = map(list, zip(*base)) if base else ([], [], [])
            parts: list[list] = [[], [], [], []]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(words[end]) <= BATCH_WORDS):
                    size += len(words[end])
                    end += 1
                for part, values in zip(parts, of_batch(texts[at:end], words[at:end])):
                    part += values
                at = end
            out["n_repeat_words"], out["covered_words"], out["n_spans"], out["longest_repeat"] = parts
            return {"doc_id": columns[0], **out}

        return step

    return make


def repetition(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = 8,
    max_covered: float = 0.4,
    max_repeat: int = 64,
) -> DataFrame:
    """Judges every text by its repeated substrings; one row per input row.

    Words are ``WORD`` matches of the whole text. ``longest_repeat`` is the length
    in words of the longest substring that occurs twice; ``covered_words`` counts
    the words in the union of all maximal repeated substrings of ``min_repeat``
    words or more, every occurrence included; ``n_spans`` counts those spans.
    ``base_failed``: fewer than 50 words, or over half of them in repeated
    three-word windows. ``kept`` is false if the base fails, the covered share
    exceeds ``max_covered`` or the longest repeat exceeds ``max_repeat`` words.
    Symbols and repeated lines are counted for further rules and decide nothing.

    Null and empty texts have no word and are not kept. Repeated rows, ids that
    are null or tie, and other columns do not matter: each row is judged alone,
    and only the id and the text are read. An empty table gives an empty result.
    One task holds a batch of about ``BATCH_WORDS`` words, or one longer text.
    """
    id_type = dict(docs.dtypes)[id_col]
    schema = (
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "covered_words long, n_spans long, longest_repeat long"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = map_rows(rows, measure(min_repeat), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
