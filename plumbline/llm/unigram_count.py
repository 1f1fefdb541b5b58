"""Token counts under a unigram vocabulary: Aho-Corasick matches and a count-only Viterbi."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import inf

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows

SPACE = "▁"  # stands for a blank, also at the front of the text
UNKNOWN_PENALTY = 10.0  # below the lowest score of the vocabulary
MEMO_WORDS, MEMO_CHARS = 300_000, 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model with their scores, in order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Best score and piece count of a word; keeps no segmentation.

    Tie rules of the tokenizer: at one end, matches are tried from the longest to
    the shortest and only a strictly better score replaces; an unknown character
    is tried last, and only where no piece is exactly that character. Unknown
    characters become their UTF-8 bytes if the vocabulary has all 256 byte
    pieces; otherwise neighbouring unknown characters are one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for text, score in dict((p, s) for p, s in pieces if p).items():
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        have = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.singles = {p for p in have if len(p) == 1}
        # Two generations: when the young one is full, it becomes the old one, and what is used moves up again.
        self.memo: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        if not self.singles.issuperset(text):
            return self.word_with_unknown(text)
        n = len(text)
        best, count = [-inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for end, (size, score) in self.automaton.iter(text):
            start = end + 1 - size
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1] = total
                count[end + 1] = count[start] + 1
        return count[n], best[n]

    def word_with_unknown(self, text: str) -> tuple[int, float]:
        n = len(text)
        best, count, loose, single = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # ends up to here are settled
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                if not single[done]:
                    self.unknown_char(text, done, best, count, loose)
            start = end - size
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end], count[end] = total, count[start] + 1
            if size == 1:
                single[end] = True
        while done < n:
            done += 1
            if not single[done]:
                self.unknown_char(text, done, best, count, loose)
        return count[n], best[n]

    def unknown_char(self, text: str, end: int, best: list, count: list, loose: list) -> None:
        total = best[end - 1] + self.unknown
        if best[end] is None or total > best[end]:
            more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not loose[end - 1])
            best[end], count[end], loose[end] = total, count[end - 1] + more, True

    def text(self, text: str | None) -> tuple[int, float]:
        """Piece count and score of a whole text. No piece reaches over a word's front, so words add up."""
        if not text:
            return 0, 0.0
        parts = text.replace(" ", SPACE).split(SPACE)
        if not parts[0]:
            del parts[0]
        pieces, score = 0, 0.0
        memo = self.memo
        for part in parts:
            got = memo.get(part)
            if got is None:
                got = self.old.get(part) or self.word(SPACE + part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        self.memo, self.old = {}, memo
                        memo = self.memo
                    memo[part] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """One automaton for each worker process, re-used by its tasks."""
    return UnigramCounter(read_pieces(path))


def token_counts(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every whole text; one row per input row, no shuffle.

    ``path`` names the vocabulary, or is a function that finds it on the worker.
    Blanks count as the front of the next word and one is put before the text.
    Null and empty texts have 0 tokens and score 0. Repeated rows, null or tied
    ids and other columns do not matter: only the id and the text are read and
    each row stands alone. An empty table gives an empty result. Memory is bound
    by one text, the automaton and memos of twice ``MEMO_WORDS`` short words.
    """
    id_type = dict(docs.dtypes)[id_col]

    def make():
        count = counter(path() if callable(path) else path).text

        def step(columns: list) -> dict:
            found = [count(t) for t in columns[1]]
            return {"doc_id": columns[0], "n_tokens": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, make, f"doc_id {id_type}, n_tokens long, score double")
