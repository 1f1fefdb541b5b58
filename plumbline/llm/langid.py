"""Language identification with string kernels, Nystroem landmarks and ridge regression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, map_rows, one_text_each, sample_by_class

BUCKETS = 1 << 16  # hashed n-grams; a text's presence set is at most this large
SPECTRUM = (1, 2, 3, 4)
WORDLIKE = re.compile(r"[^\W\d_]+")
BATCH = 32


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category; fractions, superscripts and circled digits are none."""
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in WORDLIKE.finditer(text))


def presence(text: str) -> np.ndarray:
    """The hashed n-grams (code points, lower case, blended over ``SPECTRUM``) that a text has, once each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(BUCKETS, bool)
    key = np.zeros(len(points), np.uint32)
    for n in SPECTRUM:
        if len(points) < n:
            break
        key = key[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
        seen[((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    """``weights`` (n-grams x languages): landmarks, whitening and ridge solution in one matrix."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest outputs of a batch: its presence matrix times the weights."""
        rows = np.zeros((len(sets), BUCKETS), np.float32)
        for row, found in zip(rows, sets):
            row[found] = 1
        size = np.sqrt(np.maximum([len(s) for s in sets], 1))
        return (rows @ self.weights) / size[:, None]


def fit_kernel(samples: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> KernelModel:
    """Kernel ridge regression on the normalised presence kernel k(x, y) = |x and y| / sqrt(|x| |y|).

    The landmarks are dealt over the languages in turn. With K the kernel of
    samples and landmarks and M that of the landmarks, features are K M^(-1/2).
    """
    samples = [(lang, found) for lang, found in samples if len(found)]
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return KernelModel([], np.zeros((BUCKETS, 0), np.float32))
    turn: dict[str, int] = {}
    order = []
    for at, (lang, _) in enumerate(samples):
        turn[lang] = turn.get(lang, 0) + 1
        order.append((turn[lang], lang, at))
    chosen = [at for _, _, at in sorted(order)[:landmarks]]
    marks = np.zeros((BUCKETS, len(chosen)), np.float32)
    for column, at in enumerate(chosen):
        found = samples[at][1]
        marks[found, column] = 1 / np.sqrt(len(found))
    kernel = np.array([marks[found].sum(0, dtype=np.float64) / np.sqrt(len(found)) for _, found in samples])
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    target = np.array([[float(lang == x) for x in languages] for lang, _ in samples])
    # Each language weighs the same, however often the sample has it.
    share = np.array([1 / (len(languages) * turn[lang]) for lang, _ in samples])
    gram = (features * share[:, None]).T @ features + ridge / len(samples) * np.eye(features.shape[1])
    solution = np.linalg.solve(gram, (features * share[:, None]).T @ target)
    return KernelModel(languages, (marks @ (whiten @ solution).astype(np.float32)).astype(np.float32))


def train(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, landmarks: int, ridge: float, fold: tuple[int, int] | None
) -> KernelModel:
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    if fold:
        keys = keys.where(crc_mod("doc_id", fold[0]) != fold[1])
    drawn = sample_by_class(keys.distinct(), "lang", per_language)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = one_text_each(texts.where(F.col("text").isNotNull()), drawn, "lang").select("doc_id", "lang", "text")

    def make():
        def step(columns: list) -> dict:
            bits = [np.packbits(np.bincount(presence(t), minlength=BUCKETS).astype(bool)).tobytes() for t in columns[2]]
            return {"doc_id": columns[0], "lang": columns[1], "bits": bits}

        return step

    # Bounded for the driver: 8 KiB for each drawn id, whatever its length.
    found = map_rows(rows, make, f"doc_id {dict(docs.dtypes)[id_col]}, lang string, bits binary").toLocalIterator()
    samples = sorted(((str(r["doc_id"]), r["lang"], bytes(r["bits"])) for r in found), key=lambda r: (len(r[0]), r[0], r[2]))
    unpack = lambda bits: np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
    return fit_kernel([(lang, unpack(bits)) for _, lang, bits in samples], landmarks, ridge)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    landmarks: int = 192,
    ridge: float = 0.05,
    fold: tuple[int, int] | None = (4, 2),
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text; one row per input row.

    Learns from at most about ``per_language`` labelled rows of every
    language, never from rows of the held-out ``fold`` (divisor,
    remainder of crc32 of the id); the model is 64 Ki hashed n-grams times the number
    of languages. ``score`` is the winner's regression output, cut to 0..1.

    Null texts and texts without a letter are ``und`` with score 0; so is all if
    nothing could be learned. Labels may be null; repeated rows and ties are
    scored alike, ties between languages go to the first by name. An id with several
    languages is learned once for each, with a text of that row. A null id is
    scored but never learned from. Extra columns are not read.
    """
    model = train(docs, id_col, text_col, lang_col, per_language, landmarks, ridge, fold)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (crc_mod(id_col, fold[0]) == fold[1] if fold else F.lit(False)).alias("held_out"),
            F.col(text_col).cast("string").alias("text"),
        ),
        scorer(shared),
        f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double",
    )


def scorer(shared) -> Callable[[], Callable[[list], dict]]:
    def make():
        model = shared.value

        def step(columns: list) -> dict:
            texts = columns[2]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            live = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            for at in range(0, len(live), BATCH):
                part = live[at : at + BATCH]
                out = model.scores([presence(texts[i]) for i in part])
                for i, row in zip(part, out):
                    best = int(np.argmax(row))
                    langs[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, row[best])))
            return {"doc_id": columns[0], "held_out": columns[1], "lang_pred": langs, "score": scores}

        return step

    return make
