"""Toxicity scores from a classifier that is held steady when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, map_rows, one_text_each, sample_by_class
from plumbline.session import ship_package

WORD = re.compile(r"\w+")
RIDGE = 3e-5

# Groups of terms that may stand for each other without changing whether a text is toxic.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "woman", "man", "girls", "boys", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young", "old"),
    # German
    ("frauen", "männer", "frau", "mann", "mädchen", "jungen", "transfrauen", "transmänner"),
    ("schwul", "lesbisch", "bisexuell", "homosexuell", "heterosexuell"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "amerikaner", "türken", "araber"),
    ("einwanderer", "flüchtlinge", "flüchtling", "ausländer", "migranten"),
    ("gehörlose", "blinde", "behinderte", "alte", "junge"),
    # French
    ("femmes", "hommes", "femme", "homme", "filles", "garçons", "transgenre"),
    ("gay", "lesbienne", "bisexuel", "homosexuel", "hétérosexuel"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "américains", "arabes"),
    ("immigrés", "immigrants", "réfugiés", "étrangers", "migrants"),
    ("sourds", "aveugles", "handicapés", "vieux", "jeunes"),
    # Spanish
    ("mujeres", "hombres", "mujer", "hombre", "chicas", "chicos", "transgénero"),
    ("gay", "lesbiana", "bisexual", "homosexual", "heterosexual"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "americanos", "latinos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("sordos", "ciegos", "discapacitados", "viejos", "jóvenes"),
)


STEMS = (4, 5, 6)  # lengths of the word fronts that are features beside the whole words


def whole_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def with_fronts(words: set[str]) -> set[str]:
    return words.union(*[{"^" + w[:k] for w in words if len(w) >= k} for k in STEMS])


def words_of(text: str | None) -> set[str]:
    """The words of a text and their fronts, marked, so that a stem counts whatever its ending."""
    return with_fronts(whole_words(text))


Swap = tuple[tuple[int, ...], tuple[int, ...]]  # features that go, features that come


def swaps_of(words: set[str], groups: Sequence[Sequence[str]], at: Mapping[str, int]) -> list[Swap]:
    """What each swap of an identity term for another of its group, or for nothing, changes in the features.

    The features are those of the whole text: a front that another word has too stays.
    """
    have, out = with_fronts(words), []
    for group in groups:
        for term in (t for t in group if t in words):
            for other in [t for t in group if t not in words] + [None]:
                then = with_fronts(words - {term} | ({other} if other else set()))
                known = lambda features: tuple(sorted(at[f] for f in features if f in at))
                out.append((known(have - then), known(then - have)))
    return out


class ToxicModel:
    """Weights of words (present or not) and a bias; the score is a logistic value."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        weights = self.weights
        total = self.bias + sum(weights[w] for w in sorted(words_of(text) & weights.keys()))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, total)))))


def fit_counterfactual(
    samples: list[tuple[int, list[int]]],
    vocabulary: list[str],
    groups: Sequence[Sequence[str]],
    swap_penalty: float,
    sparsity: float,
    steps: int = 1000,
    swaps: Mapping[Swap, int] | None = None,
) -> ToxicModel:
    """Logistic regression by accelerated proximal gradient.

    Loss: balanced log loss + ``swap_penalty`` times the mean squared change of
    the score (before the logistic) when an identity term of a sentence is
    swapped for another of its group or left out, its fronts with it, +
    ``sparsity`` times the sum of the weights. ``swaps`` says how often a swap
    changes which features; without it the words of a sample are taken to be
    those that the vocabulary has. Weights are not negative: a word may speak for toxicity, but no
    wealth of harmless words excuses it, however long the text. The words that this leaves are fitted once more without
    the last term, which shrinks large weights, but for a slight ``RIDGE``.
    """
    labels = np.array([y for y, _ in samples], float)
    if not len(labels) or labels.min() == labels.max():
        return ToxicModel({}, 0.0)  # one class alone tells nothing
    n, width = len(samples), len(vocabulary)
    rows = np.repeat(np.arange(n), [len(f) for _, f in samples])
    cols = np.array([c for _, f in samples for c in f], np.int64)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    at = {w: i for i, w in enumerate(vocabulary)}
    if swaps is None:
        swaps = Counter(change for _, found in samples for change in swaps_of({vocabulary[c] for c in found if vocabulary[c][0] != "^"}, groups, at))
    changes = sorted((change, n) for change, n in swaps.items() if change[0] or change[1])
    often = np.array([n for _, n in changes], float)
    often /= max(1.0, float(sum(swaps.values())))
    change = np.repeat(np.arange(len(changes)), [len(gone) + len(come) for (gone, come), _ in changes])
    moving = np.array([c for (gone, come), _ in changes for c in gone + come], np.int64)
    sign = np.array([x for (gone, come), _ in changes for x in [1.0] * len(gone) + [-1.0] * len(come)])

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = b + np.bincount(rows, w[cols], n)
        off = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.bincount(cols, off[rows], width)
        if len(changes):
            moved = np.bincount(change, sign * w[moving], len(changes))
            push = 2 * swap_penalty * often * moved
            g += np.bincount(moving, sign * push[change], width)
        return g, float(off.sum())

    # A bound of the curvature: rows weigh share/4 and have at most their own number of words.
    sizes = np.bincount(rows, minlength=n)
    probe = np.random.default_rng(0).normal(size=width)
    top = 1.0
    for _ in range(30):
        z = share * np.bincount(rows, probe[cols], n) / 4
        probe = np.bincount(cols, z[rows], width)
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    # A bound of the penalty's curvature: the largest sum of a row of its matrix.
    bend = float(np.bincount(moving, (often * np.bincount(change, minlength=len(changes)))[change], width).max()) if len(changes) else 0.0
    rate = 1 / (1.2 * top + 0.25 + 2 * swap_penalty * bend + 1e-9 * sizes.max())

    def descend(allowed: np.ndarray, sparse: float, ridge: float) -> tuple[np.ndarray, float]:
        w, b = np.zeros(width), 0.0
        v, vb, momentum = w.copy(), b, 1.0
        for _ in range(steps):
            g, gb = gradient(v, vb)
            new = (v - rate * (g + ridge * v)) * allowed
            new = np.maximum(new - rate * sparse, 0)
            new_b = vb - rate * gb
            following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            v = new + (momentum - 1) / following * (new - w)
            vb = new_b + (momentum - 1) / following * (new_b - b)
            w, b, momentum = new, new_b, following
        return w, b

    w, _ = descend(np.ones(width), sparsity, 0.0)
    w, b = descend(w != 0, 0.0, RIDGE)
    return ToxicModel({vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}, b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    groups: Sequence[Sequence[str]],
    per_class: int,
    vocabulary_size: int,
    swap_penalty: float,
    sparsity: float,
    fold: tuple[int, int] | None,
) -> ToxicModel:
    keys = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    keys = keys.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if fold:
        keys = keys.where(crc_mod("doc_id", fold[0]) != fold[1])
    # A document labelled twice counts as toxic if one label says so.
    keys = keys.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = sample_by_class(keys, "toxic", per_class)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = one_text_each(texts, drawn, "toxic").select("toxic", "text")

    def split():
        return lambda columns: {"toxic": columns[0], "words": [sorted(words_of(t)) for t in columns[1]]}

    found = map_rows(rows, split, "toxic int, words array<string>")
    sizes = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    even = F.lit(float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))))
    yes, no = F.sum("toxic"), F.sum(F.lit(1) - F.col("toxic"))
    # How far a word's odds are from those of the classes, in standard errors.
    odds = F.abs(F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5)) - even) / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    telling = (
        found.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(yes.alias("yes"), no.alias("no"))
        .where("yes + no >= 3")
        .orderBy(odds.desc(), "word")
        .limit(vocabulary_size)
        .select("word")
    )
    terms = [t for group in groups for t in group]
    vocabulary = sorted({r["word"] for r in telling.collect()} | set(terms))
    at = {w: i for i, w in enumerate(vocabulary)}

    def encode():
        def step(columns: list) -> dict:
            words = [whole_words(t) for t in columns[1]]
            swaps = [[{"gone": gone, "come": come} for gone, come in swaps_of(w, groups, at)] for w in words]
            return {"toxic": columns[0], "found": [sorted(at[w] for w in with_fronts(ws) & at.keys()) for ws in words], "swaps": swaps}

        return step

    # Bounded for the driver: the drawn ids times the size of the vocabulary, and the swaps of the terms.
    samples, swaps = [], Counter()
    for r in map_rows(rows, encode, "toxic int, found array<int>, swaps array<struct<gone:array<int>,come:array<int>>>").toLocalIterator():
        samples.append((r["toxic"], list(r["found"])))
        swaps.update((tuple(x["gone"]), tuple(x["come"])) for x in r["swaps"])
    return fit_counterfactual(sorted(samples), vocabulary, groups, swap_penalty, sparsity, swaps=swaps)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
    per_class: int = 2000,
    vocabulary_size: int = 4096,
    swap_penalty: float = 1.0,
    sparsity: float = 3e-3,
    cut: float = 0.7,
    fold: tuple[int, int] | None = (3, 1),
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; one row per input row.

    Learns from at most about ``per_class`` labelled rows of each class outside
    the held-out ``fold``; words that tell the classes apart best, and all
    identity terms, form the vocabulary. Scoring looks at every word of a text,
    has no shuffle and broadcasts at most ``vocabulary_size`` weights.

    Null and empty texts get the score of a text without known words. Null
    labels and ids are not learned from, repeated rows score alike, a document
    with two labels counts as toxic if one says so, extra columns are not read,
    and without both classes nothing is learned: every score is 0.5, below the cut.
    """
    model = train(docs, labels, id_col, text_col, label_col, groups, per_class, vocabulary_size, swap_penalty, sparsity, fold)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (crc_mod(id_col, fold[0]) == fold[1] if fold else F.lit(False)).alias("held_out"),
        score_column(docs.sparkSession, model, F.col(text_col)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def score_column(spark: SparkSession, model: ToxicModel, text: Column) -> Column:
    """The score of a text column, so that rows can be scored in place without a join."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        of_text = shared.value.score
        return pd.Series([of_text(t) for t in texts], dtype=float)

    return score(text.cast("string"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, fold: tuple[int, int] | None = (3, 1)) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``; each row is judged by its own text, whatever its id."""
    model = train(docs, labels, "doc_id", "text", "toxic", IDENTITY_TERMS, 2000, 4096, 1.0, 3e-3, fold)
    return docs.where(score_column(docs.sparkSession, model, F.col("text")) < cut)
