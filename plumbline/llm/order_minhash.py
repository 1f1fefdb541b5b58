"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, components, map_rows

WORDS = 5  # words of a shingle
BLOCK = 512  # members of a mixed bucket that a task compares at a time
BLOCK_WORDS = 1 << 20  # and about as many words
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)

BINS = 256  # word counts of a text are summed in so many bins by the hash of the word
PAIRS = 4096  # pairs of a block whose bins are compared at a time


@lru_cache(maxsize=300_000)
def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x51ED270B))  # one for each band


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the five-word shingles in text order; a shorter text is one shingle."""
    ids = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = mix(out + ids[i : i + n] * _PRIMES[i])
    return out


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key came before: the labels that tell equal shingles apart."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    index = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return out.astype(np.uint64)


def sketch(words: list[str], bands: int, picks: int) -> np.ndarray:
    """Order MinHash: for each band the ``picks`` labelled shingles of least hash, joined in text order."""
    keys = shingles(words)
    labelled = mix(keys + occurrences(keys) * np.uint64(0x9E3779B97F4A7C15))
    picks = min(picks, len(keys))
    at = np.empty((bands, picks), np.int64)
    for band in range(bands):
        value = (labelled ^ _SEEDS[band]) * _PRIMES[1]
        value ^= value >> np.uint64(32)
        at[band] = np.argpartition(value, picks - 1)[:picks]
    at.sort(axis=1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for pick in range(picks):
        out = mix(out + keys[at[:, pick]] * _PRIMES[0])
    return out.view(np.int64)


def bag(words: list[str]) -> np.ndarray:
    """Number of words in each of ``BINS`` bins, at most 127.

    Putting words together and cutting counts off only brings two texts closer,
    so the bins differ by no more than the words do.
    """
    ids = np.fromiter(map(word_hash, words), np.uint64, len(words))
    counts = np.bincount((ids % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 127).astype(np.int8)


GRAMS = (1, 2, 3)
SHALLOW = 12  # edits up to which diagonals are walked


def profile(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and triples of neighbouring words: the different ones (hashed) and how often they come."""
    ids = np.fromiter(map(word_hash, words), np.uint64, len(words))
    out = []
    for n in GRAMS:
        keys = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for i in range(n if len(keys) else 0):
            keys = mix(keys + ids[i : i + len(keys)] * _PRIMES[i])
        out.append(np.unique(keys, return_counts=True))
    return out


def may_align(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], most: int) -> bool:
    """False if no ``most`` edits turn one text into the other: an edit takes and adds at most n of the runs of n words."""
    for n, (ka, ca), (kb, cb) in zip(GRAMS, a, b):
        _, at, bt = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        if ca.sum() + cb.sum() - 2 * np.minimum(ca[at], cb[bt]).sum() > 2 * n * most:
            return False
    return True


def edit_distance(a: list, b: list, most: int) -> int:
    """Words to insert, delete or replace, or ``most + 1`` if it is over ``most``.

    What both texts start and end with is left out. A few edits are found by walking
    the diagonals next to the main one; beyond ``SHALLOW`` edits whole columns of the
    table are advanced as bits of long integers, until ``most`` can no longer be met.
    """
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    near = walk_diagonals(a, b, min(most, SHALLOW))
    return near if near <= min(most, SHALLOW) or most <= SHALLOW else advance_columns(a, b, most)


def walk_diagonals(a: list, b: list, most: int) -> int:
    """For each number of edits the farthest point of every diagonal within ``most`` of the main one."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    reach = {0: 0}
    goal = n - m
    for edits in range(most + 1):
        for k, i in reach.items():
            j = i - k
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            reach[k] = i
        if reach.get(goal, -1) >= n:
            return edits
        following = {}
        spare = most - edits - 1
        for k in range(max(-edits - 1, goal - spare), min(edits + 1, goal + spare) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -1))
            if i >= 0:
                following[k] = min(i, n, m + k)
        reach = following
    return most + 1


def advance_columns(a: list, b: list, most: int) -> int:
    """The table column by column: where a cell is one more or one less than the cell above it is one bit for each word of ``a``."""
    at: dict = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | (1 << i)
    last, full = len(a) - 1, (1 << len(a)) - 1
    more, less, score = full, 0, len(a)
    for left, word in zip(range(len(b) - 1, -1, -1), b):
        equal = at.get(word, 0)
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | (full & ~(across | more)), more & across
        score += (up >> last & 1) - (down >> last & 1)
        if score - left > most:  # each word that is left takes off one at most
            return most + 1
        up, down = (up << 1) | 1, down << 1
        equal |= less
        more = (down | ~(equal | up)) & full
        less = up & equal & full
    return score


def similar(a: list[str], b: list[str], threshold: float) -> bool:
    """Whether 1 - edits / longer length reaches ``threshold``, aligned word by word in a band."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if not may_align(profile(a), profile(b), most):
        return False
    return edit_distance(a, b, most) <= most


def describe(bands: int, picks: int) -> Callable[[], Callable[[list], dict]]:
    def make():
        def step(columns: list) -> dict:
            # id, digest of the text, text
            words = [t.split() if t else [] for t in columns[2]]
            marks = [blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() if w else None for w in words]
            sketches = [sketch(w, bands, picks) if w else None for w in words]
            bags = [bag(w) if w else None for w in words]
            return {"doc_id": columns[0], "text_key": columns[1], "mark": marks, "n_words": [len(w) for w in words], "sketch": sketches, "bag": bags}

        return step

    return make


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    bands: int = 16,
    picks: int = 3,
) -> DataFrame:
    """``doc_id, class_id, kept, n_words, text_key`` (md5): the near-duplicate class of every row.

    ``class_id`` is the smallest id of the class. ``kept`` is true for the row
    whose id names the class; rows without a word and those with a null id and no
    partner are classes by themselves (class_id = own id) and kept.

    Two different texts are linked if they share one of ``bands`` sketches, each
    of ``picks`` five-word shingles in text order, and their words align with a
    similarity (1 - edits / longer length) of ``threshold`` or more. With a
    shingle similarity of 0.8 a band agrees about half of the time, so sixteen
    miss a pair of long texts about once in 60,000; texts of few shingles share no
    band more often.

    Rows with the same words are one node from the start. In each bucket all
    members are compared with its smallest. Where members of different classes are
    left in a bucket, blocks of at most about ``BLOCK`` members compare them inside
    a task: first each block by itself, then the members outside the class of the
    bucket's smallest with all other blocks. A task aligns every two members of
    different classes unless their lengths, their words or the runs of two
    and three neighbouring words take more edits than a link may have. These are bounds,
    not estimates, so no link between two members of a bucket is missed. Classes
    that meet in the task are one from then on, so it aligns no more of their pairs
    and sends no more than one link a member: no pairs are rows. No bucket is cut
    off, and texts of any length are aligned whole. Repeated rows fall together, a
    null text is a text without words, an empty table gives an empty result and
    columns beyond id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "orderminhash")
    id_type = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    schema = f"doc_id {id_type}, text_key binary, mark binary, n_words int, sketch array<bigint>, bag array<tinyint>"
    rows = scratch.table(map_rows(texts, describe(bands, picks), schema), "rows")
    worded = rows.where("mark IS NOT NULL")
    nodes = scratch.table(worded.groupBy("mark").agg(F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"), F.first("bag").alias("bag")), "nodes")
    members = nodes.select("mark", "n_words", F.posexplode("sketch").alias("band", "value"))
    heads = members.groupBy("band", "value").agg(F.min("mark").alias("head"), F.max("mark").alias("last")).where("head <> last").drop("last")
    buckets = scratch.table(members.join(heads, ["band", "value"]), "buckets")
    tried = scratch.table(
        buckets.where("mark <> head").select(F.col("head").alias("a"), F.col("mark").alias("b")).distinct(), "pairs"
    )
    # Every member of a bucket is in one of these pairs, so the rounds below need no other text.
    body = texts_of(tried.select(F.col("a").alias("mark")).unionAll(tried.select("b")).distinct(), texts, rows, scratch)
    links = scratch.table(verify(tried, body, threshold), "links")
    classes = components(links, scratch, "a", "b")
    for across in (False, True):
        more = rest_of(buckets, nodes, classes, body, threshold, scratch, across)
        if more is not None and not more.isEmpty():
            links = links.unionByName(more)
            classes = components(links, scratch, "a", "b")
    in_class = worded.join(classes.withColumnRenamed("node", "mark"), "mark", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("component", "mark").alias("component")
    )
    named = in_class.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    placed = in_class.join(named, "component").select("doc_id", "class_id", "n_words", "text_key")
    alone = rows.where("mark IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), "n_words", "text_key")
    return placed.unionByName(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_words", "text_key")


def rest_of(
    buckets: DataFrame, nodes: DataFrame, classes: DataFrame, body: DataFrame, threshold: float, scratch: Scratch, across: bool
) -> DataFrame | None:
    """Links ``a, b`` that join the classes left in mixed buckets: within blocks, or ``across`` blocks of one bucket."""
    placed = buckets.join(classes.withColumnRenamed("node", "mark"), "mark", "left").select(
        "band", "value", "mark", "head", "n_words", F.coalesce("component", "mark").alias("class")
    )
    mixed = placed.groupBy("band", "value").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words"),
        F.max(F.when(F.col("mark") == F.col("head"), F.col("class"))).alias("main"),
    )
    blocks = lambda n, words: F.ceil(F.greatest(n / F.lit(BLOCK), words / F.lit(BLOCK_WORDS))).cast("int")
    mixed = mixed.where("low <> high").withColumn("blocks", blocks(F.col("size"), F.col("words")))
    if across:
        mixed = mixed.where("blocks > 1")
    placed = placed.join(mixed.select("band", "value", "main", "blocks"), ["band", "value"])
    placed = scratch.table(placed.withColumn("own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")).drop("head"), "mixed")
    if placed.isEmpty():
        return None
    full = placed.join(nodes.select("mark", "sketch", "bag"), "mark").join(body, "mark")
    if across:
        # Few are outside the main class as a rule; their blocks are dealt anew, so that others are copied no more often than needed.
        stray = full.where(F.col("class") != F.col("main"))
        sizes = stray.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
        sizes = scratch.table(sizes.select("band", "value", blocks(F.col("n"), F.col("w")).alias("left_blocks")), "strays")
        left = stray.join(sizes, ["band", "value"]).withColumn("x", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("left_blocks")).cast("int"))
        left = left.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
        right = full.join(sizes, ["band", "value"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
        right = right.withColumn("y", F.col("own")).withColumn("side", F.lit(1))
        cells = left.select(right.columns).unionByName(right)
    else:
        cells = full.withColumn("x", F.col("own")).withColumn("y", F.col("own")).withColumn("side", F.lit(0))
    cells = cells.select("band", "value", "x", "y", "side", "own", "mark", "n_words", "class", "main", "sketch", "bag", "text")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left = group[group["side"] == 0].reset_index(drop=True)
        right = group[group["side"] == 1].reset_index(drop=True) if across else left
        return pd.DataFrame(block_links(int(key[0]), left, right, across, threshold), columns=["a", "b"])

    return scratch.table(cells.groupBy("band", "value", "x", "y").applyInPandas(compare, "a binary, b binary"), "links")


def block_links(band: int, left: pd.DataFrame, right: pd.DataFrame, across: bool, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between members of ``left`` and ``right`` that join classes not yet joined."""
    if not len(left) or not len(right):
        return []
    ls, rs = np.array(left["sketch"].tolist()), np.array(right["sketch"].tolist())
    ln, rn = left["n_words"].to_numpy().astype(np.int64), right["n_words"].to_numpy().astype(np.int64)
    lm, rm = left["mark"].to_numpy(), right["mark"].to_numpy()
    lc, rc = left["class"].to_numpy(), right["class"].to_numpy()
    fits = lc[:, None] != rc[None, :]
    if across:  # blocks have been compared by themselves; of two strays the smaller one asks
        stray = rc != right["main"].to_numpy()
        fits &= (left["own"].to_numpy()[:, None] != right["own"].to_numpy()[None, :]) & (~stray[None, :] | (lm[:, None] < rm[None, :]))
    else:
        fits &= lm[:, None] < rm[None, :]
    for earlier in range(band):  # a pair counts in the first of its common buckets alone; that one is mixed too, as the classes differ
        fits &= ls[:, earlier, None] != rs[None, :, earlier]
    differ = np.abs(ln[:, None] - rn[None, :])
    most = np.floor(np.maximum(ln[:, None], rn[None, :]) * (1 - threshold) + 1e-9)
    rows, cols = np.nonzero(fits & (differ <= most))
    lb, rb = np.array(left["bag"].tolist(), np.int16), np.array(right["bag"].tolist(), np.int16)
    words: dict[bytes, list[str]] = {}
    grams: dict[bytes, list] = {}

    def of(table: pd.DataFrame, at: int) -> tuple[list[str], list]:
        mark = table["mark"].iat[at]
        if mark not in words:
            words[mark] = table["text"].iat[at].split()
            grams[mark] = profile(words[mark])
        return words[mark], grams[mark]

    bounds = [np.abs(lb[rows[at : at + PAIRS]] - rb[cols[at : at + PAIRS]]).sum(1) for at in range(0, len(rows), PAIRS)]
    # Twice the words that only the longer side has are the words of either side alone and the difference of the lengths.
    least = (np.concatenate(bounds) + differ[rows, cols]) if bounds else np.zeros(0)
    up: dict[bytes, bytes] = {}

    def top(name: bytes) -> bytes:
        while name in up:
            name = up[name]
        return name

    found = []
    # The likeliest pairs first, so that classes are joined early and most others need no look.
    for i in np.argsort(least, kind="stable").tolist():
        r, c = rows[i], cols[i]
        if least[i] > 2 * most[r, c]:
            continue
        a, b = top(lc[r]), top(rc[c])
        if a == b:
            continue
        (wa, ga), (wb, gb) = of(left, r), of(right, c)
        limit = int(most[r, c])
        if may_align(ga, gb, limit) and edit_distance(wa, wb, limit) <= limit:
            up[max(a, b)] = min(a, b)
            found.append((min(lm[r], rm[c]), max(lm[r], rm[c])))
    return found


def texts_of(wanted: DataFrame, texts: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``mark, text``: one text for each mark, fetched by an id and the text's digest."""
    place = F.struct("text_key", "doc_id")
    owner = rows.join(wanted, "mark", "left_semi").groupBy("mark").agg(F.min(place).alias("at"))
    owner = owner.select("mark", F.col("at.text_key").alias("text_key"), F.col("at.doc_id").alias("owner_id"))
    found = texts.join(owner, (texts["text_key"] == owner["text_key"]) & texts["doc_id"].eqNullSafe(owner["owner_id"]))
    return scratch.table(found.select("mark", "text").dropDuplicates(["mark"]), "texts")


def verify(pairs: DataFrame, body: DataFrame, threshold: float) -> DataFrame:
    """The pairs of marks whose texts (``body``: ``mark, text``) align."""
    left = pairs.join(body.select(F.col("mark").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(body.select(F.col("mark").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def make():
        def step(columns: list) -> dict:
            a, b, ta, tb = columns
            good = [i for i in range(len(a)) if similar(ta[i].split(), tb[i].split(), threshold)]
            return {"a": [a[i] for i in good], "b": [b[i] for i in good]}

        return step

    return map_rows(both, make, "a binary, b binary")
