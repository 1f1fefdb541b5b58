"""Document rates that bring the token totals of softly assigned domains to given weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, map_rows, one_text_each, sample_by_class, unit_hash

BUCKETS = 1 << 16  # hashed byte trigrams
ADDED = ("mix_tokens", "mix_posteriors", "mix_rate", "mix_copies")
EVIDENCE = 6.0  # a text counts as so many independent trigrams, whatever its length


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text, in lower case; an empty text has none."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class DomainModel:
    """Naive Bayes over trigrams: ``log_odds`` (trigrams x domains), class prior, and a temperature."""

    domains: list[str]
    log_odds: np.ndarray
    prior: np.ndarray

    def posteriors(self, text: str | None) -> np.ndarray:
        """Probabilities of the domains; soft, because the trigrams of a text are far from independent."""
        score = np.log(self.prior)
        found = trigrams(text) if text else []
        if len(found):
            score = score + EVIDENCE * self.log_odds[found].mean(0, dtype=np.float64)
        score = np.exp(score - score.max())
        return score / score.sum()


def fit_domains(counts: list[tuple[str, np.ndarray]], prior: Mapping[str, float]) -> DomainModel:
    domains = sorted(prior)
    table = np.full((BUCKETS, len(domains)), 0.5)
    for domain, found in counts:
        table[:, domains.index(domain)] += found
    table /= table.sum(0)
    logs = np.log(table)
    share = np.array([prior[d] for d in domains], float)
    return DomainModel(domains, (logs - logs.mean(1, keepdims=True)).astype(np.float32), share / share.sum())


def train(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, per_domain: int) -> DomainModel | None:
    keys = labelled.select(F.col(id_col).alias("doc_id"), F.col(domain_col).cast("string").alias("domain"))
    keys = keys.where("doc_id IS NOT NULL AND domain IS NOT NULL")
    prior = {r["domain"]: r["n"] for r in keys.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not prior:
        return None
    # Of an id with several domains the first by name counts.
    drawn = sample_by_class(keys.groupBy("doc_id").agg(F.min("domain").alias("domain")), "domain", per_domain)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = one_text_each(texts, drawn, "domain").select("domain", "text")

    def make():
        def step(columns: list) -> dict:
            out: dict[str, list] = {"domain": columns[0], "counts": []}
            for text in columns[1]:
                found, times = np.unique(trigrams(text), return_counts=True)
                # Each document counts as much as any other, whatever its length; whole numbers add up alike in any order.
                share = np.rint(times * (1e9 / max(1, times.sum()))).astype(np.int64)
                out["counts"].append([{"at": a, "n": n} for a, n in zip(found.tolist(), share.tolist())])
            return out

        return step

    # Summed on the executors; the driver gets one row for each domain and trigram, so at most ``BUCKETS`` rows a domain.
    listed = map_rows(rows, make, "domain string, counts array<struct<at: int, n: long>>").select("domain", F.explode("counts").alias("c"))
    summed = listed.groupBy("domain", "c.at").agg(F.sum("c.n").alias("n")).collect()
    counts = {d: np.zeros(BUCKETS) for d in prior}
    for r in summed:
        counts[r["domain"]][r["at"]] = r["n"] / 1e6
    return fit_domains(sorted(counts.items()), prior)


def descend(tokens: np.ndarray, shares: np.ndarray, steps: np.ndarray, stay: float, rate: float) -> np.ndarray:
    """Rates after the given steps, from 1: projected on the nonnegative numbers after each.

    ``steps`` are the gradients of the domain totals. A document's part of a
    gradient is the mean over its posteriors, in the metric of its tokens, so the
    rates depend on the posteriors alone and a repeated run gives the same.
    """
    r = np.ones(len(tokens))
    for g in steps:
        r = np.maximum(0.0, r - rate * (shares @ g + stay * (r - 1)))
    return r


def totals_of(facts: DataFrame, domains: int, steps: np.ndarray, stay: float, rate: float) -> np.ndarray:
    """Expected tokens of each domain under the rates after ``steps``: one row of sums from each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(domains)
        for batch in batches:
            tokens = batch.column(0).to_numpy()
            shares = batch.column(1).flatten().to_numpy().reshape(len(tokens), domains)
            total += (descend(tokens, shares, steps, stay, rate) * tokens) @ shares
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(domains)], pa.int32()), pa.array(total)], ["d", "total"])

    sums = facts.select("tokens", "posteriors").mapInArrow(part, "d int, total double").groupBy("d").agg(F.sum("total").alias("t")).collect()
    out = np.zeros(domains)
    for r in sums:
        out[r["d"]] = r["t"]
    return out


@dataclass
class Mix:
    """What a mixing run reached: tokens of each domain before, wanted and after, steps taken, largest relative error left."""

    before: dict[str, float] = field(default_factory=dict)
    wanted: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    steps: int = 0
    error: float = 0.0


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float] | Callable[[dict[str, float]], Mapping[str, float]],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    per_domain: int = 400,
    iterations: int = 24,
    stay: float = 1e-3,
    keep_all: bool = False,
    report: Mix | None = None,
) -> DataFrame:
    """Nonnegative rates that bring the expected tokens of the domains to ``weights``.

    ``labelled`` names the domain of some documents (``id_col, domain_col``). A
    classifier learned from at most about ``per_domain`` of them in every
    domain gives every document posteriors; it holds 512 KiB for each domain. The
    rates minimise the squared error of the expected domain totals
    ``sum(rate * tokens * posterior)`` against the targets, relative to the
    totals, plus ``stay`` times the squared distance from 1, weighted by tokens.
    Each iteration is one distributed pass over (tokens, posteriors) that sums
    the totals; the driver holds one number for each domain.

    ``weights`` maps domains to target shares, or is a function from the present
    shares to such a mapping; unnamed domains get 0. The total stays, or with
    ``keep_all`` grows just so far that no domain has to shrink. It stops after
    ``iterations`` steps or when all totals are met; ``report`` is filled with what was
    reached and the largest error left.

    Result: every column of ``docs`` and ``mix_tokens, mix_posteriors (map),
    mix_rate, mix_copies`` (in place of input columns of these names). ``mix_copies`` is the rate rounded up or down by a
    hash of id and text with the fraction as its chance, so expected counts equal
    the rates. Tokens are runs of other than white space. Null and empty texts
    have none; they keep the prior as posteriors and rate 1. Repeated rows and
    ties get equal rates; null ids are hashed as empty; an empty table gives an
    empty result; without a labelled row all rates are 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    model = train(docs, labelled, id_col, text_col, domain_col, per_domain)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)))
    own = [docs[c] for c in docs.columns if c.lower() not in ADDED]
    if model is None:
        none = F.create_map().cast("map<string,double>")
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return docs.select(*own, words.cast("long").alias("mix_tokens"), none.alias("mix_posteriors"), F.lit(1.0).alias("mix_rate"), F.lit(1).alias("mix_copies"))
    shared = spark.sparkContext.broadcast(model)

    def make():
        domain_model = shared.value

        def step(columns: list) -> dict:
            return {
                "__mix_key": columns[0],
                "tokens": [float(len(t.split())) for t in columns[1]],
                "posteriors": [domain_model.posteriors(t) for t in columns[1]],
            }

        return step

    facts = scratch.table(map_rows(docs.select(key.alias("k"), text.alias("t")), make, "__mix_key binary, tokens double, posteriors array<double>"), "facts")
    n = len(model.domains)
    now = totals_of(facts, n, np.zeros((0, n)), stay, 1.0)
    whole = now.sum()
    wanted = weights({d: float(x) for d, x in zip(model.domains, now / max(whole, 1.0))}) if callable(weights) else weights
    share = np.array([max(0.0, float(wanted.get(d, 0.0))) for d in model.domains])
    share = share / share.sum() if share.sum() > 0 else now / max(whole, 1.0)
    goal = whole * share
    if keep_all:
        named = share > 0
        goal = float((now[named] / share[named]).max()) * share if named.any() else goal
    scale = np.maximum(now, 1.0)
    # Posterior-weighted overlap of domains bounds the curvature by the largest row sum of the relative Gram matrix: at most 1 + stay.
    rate = 1.0 / (1.0 + stay)
    steps = np.zeros((0, n))
    for _ in range(iterations):
        error = (totals_of(facts, n, steps, stay, rate) - goal) / scale
        steps = np.vstack([steps, error])
        if np.abs(error[goal > 0]).max(initial=0.0) < 1e-6:
            break
    if report is not None:
        after = totals_of(facts, n, steps, stay, rate)
        of = lambda values: dict(zip(model.domains, (float(x) for x in values)))
        report.before, report.wanted, report.after, report.steps = of(now), of(goal), of(after), len(steps)
        report.error = float((np.abs(after - goal) / scale)[goal > 0].max(initial=0.0))

    def rates():
        def step(columns: list) -> dict:
            tokens = np.array(columns[1], float)
            shares = np.array(columns[2], float).reshape(len(tokens), n)
            found = np.where(tokens > 0, descend(tokens, shares, steps, stay, rate), 1.0)
            return {
                "__mix_key": columns[0],
                "mix_tokens": [int(t) for t in tokens],
                "mix_posteriors": [dict(zip(model.domains, row.tolist())) for row in shares],
                "mix_rate": found.tolist(),
            }

        return step

    rated = map_rows(facts, rates, "__mix_key binary, mix_tokens long, mix_posteriors map<string,double>, mix_rate double").dropDuplicates(["__mix_key"])
    joined = docs.join(rated, key == F.col("__mix_key"))
    # A hair over a whole number is rounding noise, not a chance of one more copy.
    rate_of = rated["mix_rate"]
    spare = rate_of - F.floor(rate_of + 1e-9)
    copies = (F.floor(rate_of + 1e-9) + (unit_hash(F.lit(17), "__mix_key") < spare).cast("int")).cast("int")
    return joined.select(*own, *[rated[c] for c in ("mix_tokens", "mix_posteriors", "mix_rate")], copies.alias("mix_copies"))
