"""Packing of token sequences: best-fit decreasing, certified by dual feasible functions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.common import Scratch, map_rows

# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The rank encoder's pattern engine goes back over a run of white space and overflows its stack on long ones.
LONG_BLANKS = re.compile(r"\s{4096}")
GROUP_ROWS = 4096  # pieces packed by one task at a time


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer file names the vocabulary; its merges are in order of their
    ids, so a rank encoder over the same entries gives the same ids, ten times
    as fast. Texts with strings of special tokens or with very long runs of white
    space go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        letters = byte_letters()
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or LONG_BLANKS.search(text):
            ids = self.model.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: themselves, or from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """``piece, start, length, crc32`` of a document's pieces; only the first may be shorter than ``size``."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    bounds = [0, *range(first, n + 1, size)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def pieces_of(docs: DataFrame, path: str | Callable[[], str], size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of all documents."""
    closing = np.array([end_id], "<u4").tobytes()

    def make():
        encode = encoder(path() if callable(path) else path)
        return lambda columns: {"doc_id": columns[0], "pieces": [cut_pieces(encode(t or "") + closing, size) for t in columns[1]]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = f"doc_id {dict(docs.dtypes)[id_col]}, pieces array<struct<piece: int, start: long, length: long, ids_crc32: long>>"
    listed = map_rows(rows, lambda: _dicts(make()), kind)
    return listed.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")


def _dicts(step: Callable[[list], dict]) -> Callable[[list], dict]:
    names = ("piece", "start", "length", "ids_crc32")

    def run(columns: list) -> dict:
        out = step(columns)
        return {**out, "pieces": [[dict(zip(names, p)) for p in pieces] for pieces in out["pieces"]]}

    return run


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing can undercut.

    The best of the sum bound, of the functions u_k (x * (k + 1) / size rounded
    down, unless it is whole, for which x * k / size stands) and of those that
    count a piece over size - a as a whole bin and drop pieces under a.
    """
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // size)
    for k in range(1, 21):
        up = x * (k + 1)
        whole = up % size == 0
        value = np.where(whole, x * k, (up // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int(value.sum()) // (k * size)))
    counts = np.bincount(x, minlength=size + 1)
    sums = np.cumsum(counts * np.arange(size + 1))
    heads = np.cumsum(counts)
    a = np.arange(1, size // 2 + 1)
    big = heads[-1] - heads[size - a]
    middle = sums[size - a] - sums[a - 1]
    return max(best, int((big - (-middle // size)).max()))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece: longest first, each into the fullest bin that still holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
    free_mask, n = 0, 0
    for i in order.tolist():
        need = int(lengths[i])
        fits = free_mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                free_mask ^= 1 << free
        else:
            at, free = n, size
            n += 1
        bins[i], offsets[i] = at, size - free
        left = free - need
        if left:
            if not room[left]:
                free_mask |= 1 << left
            room[left].append(at)
    return bins, offsets, n


def pack_groups(pieces: DataFrame, size: int) -> DataFrame:
    """Packs each ``part`` on its own; adds ``bin, offset, used, bound`` (bins used, bins needed at least)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, size)
        return group.assign(bin=bins, offset=offsets, used=n, bound=lower_bound(lengths, size))

    return pieces.groupBy("part").applyInPandas(run, "part long, uid long, length long, bin long, offset long, used long, bound long")


def deal(pieces: DataFrame, n: int, turn: int) -> DataFrame:
    """Deals ``n`` pieces over groups of about ``GROUP_ROWS``, by a hash of their number."""
    parts = max(1, round(n / GROUP_ROWS))
    part = F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(parts)) + F.lit(turn << 40)
    return pieces.select(part.alias("part"), "uid", "length")


def pack(
    docs: DataFrame,
    path: str | Callable[[], str],
    size: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
) -> DataFrame:
    """Packs whole documents into as few sequences of at most ``size`` tokens as it can.

    Returns per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Pieces of full length are sequences by themselves. The others are
    dealt by hash over groups, each packed best-fit decreasing. Dual feasible
    functions give a lower bound of each group's bins: a group that meets it is
    done; the others put the pieces of all their bins that are not full together,
    deal them anew and pack again, up to ``rounds`` times or until none has a gap.
    A round that needs no fewer bins than before changes nothing.

    A null text is empty: only the end id. Repeated rows and tied or null ids are
    packed as often as they come; columns beyond id and text are not read; an
    empty table gives an empty result. Tokens never leave the tasks: what is
    shuffled are numbers and lengths of pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces_of(docs, path, size, end_id, id_col, text_col)
    pieces = scratch.table(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size).select("uid", "length")
    done: list[DataFrame] = []
    waiting, n = short, short.count()
    packed = scratch.table(pack_groups(deal(waiting, n, 0), size), "packed")
    for turn in range(1, rounds + 1):
        filled = packed.groupBy("part", "bin").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("held"))
        bins = packed.where("used > bound").join(filled, ["part", "bin"])
        open_bins = bins.where(F.col("filled") < size)
        before = open_bins.agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        if not before[0]:
            break
        again = scratch.table(pack_groups(deal(open_bins.select("uid", "length"), before[0], turn), size), "packed")
        after = again.agg(F.count_distinct("part", "bin")).first()[0]
        if after >= before[1]:
            break
        done.append(packed.join(open_bins.select("uid"), "uid", "left_anti"))
        packed = again
    placed = packed
    for more in done:
        placed = placed.unionByName(more)
    placed = placed.select("uid", ((F.col("part") * F.lit(GROUP_ROWS * 64)) + F.col("bin")).alias("sequence_id"), "offset")
    whole = pieces.where(F.col("length") >= size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(whole), "uid").drop("uid")
