"""Ranked lexical search of many items at once, sharing what their queries have in common."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import Scratch, map_rows
from plumbline.llm.terms import terms

BLOCK_ITEMS = 512  # items that are evaluated together
BLOCK_WORDS = 100_000  # and their words
SHARED_TERMS = 48  # operands of an item among which shared sets are mined
DOCS = 256  # documents whose accumulators are held at a time


class SharingPlan:
    """A graph of partial sums: leaves are terms (times their repeats), inner nodes add two nodes, items end at a node.

    Shared sets are mined greedily: the pair of operands that most items have in
    common becomes a node of its own and replaces both in all those items, until no
    pair is left in two items. What the items share is so added up once for each
    document; the rest of an item is a chain of additions.
    """

    def __init__(self, items: list[list[bytes]]):
        counts = [Counter(words) for words in items]
        self.terms = sorted({t for c in counts for t in c})
        at = {t: i for i, t in enumerate(self.terms)}
        leaves = sorted({(at[t], n) for c in counts for t, n in c.items()})
        self.leaf_term = np.array([t for t, _ in leaves], np.int64)
        self.leaf_times = np.array([n for _, n in leaves], np.int64)
        number = {leaf: i for i, leaf in enumerate(leaves)}
        self.adds: list[tuple[int, int]] = []  # node len(leaves) + i is the sum of these two
        operands = [{number[at[t], n] for t, n in c.items()} for c in counts]
        self.shared = self._mine(operands, len(leaves))
        self.ends = [self._chain(sorted(ops), len(leaves)) for ops in operands]

    def _mine(self, operands: list[set[int]], base: int) -> int:
        spread = Counter(x for ops in operands for x in ops)
        mined = [set(sorted((x for x in ops if spread[x] > 1), key=lambda x: (-spread[x], x))[:SHARED_TERMS]) for ops in operands]
        holders: dict[tuple[int, int], set[int]] = {}

        def pair(a: int, b: int) -> tuple[int, int]:
            return (a, b) if a < b else (b, a)

        for i, ops in enumerate(mined):
            for a in ops:
                for b in ops:
                    if a < b:
                        holders.setdefault((a, b), set()).add(i)
        queue = [(-len(who), p) for p, who in holders.items() if len(who) > 1]
        heapq.heapify(queue)
        while queue:
            n, (a, b) = heapq.heappop(queue)
            who = holders.get((a, b), set())
            if len(who) != -n:  # counted again when it last changed
                if len(who) > 1:
                    heapq.heappush(queue, (-len(who), (a, b)))
                continue
            node = base + len(self.adds)
            self.adds.append((a, b))
            fresh: dict[tuple[int, int], set[int]] = {}
            for i in sorted(who):
                mined[i] -= {a, b}
                operands[i] -= {a, b}
                for c in mined[i]:
                    for old in (pair(a, c), pair(b, c)):
                        holders[old].discard(i)
                    fresh.setdefault((c, node), set()).add(i)
                mined[i].add(node)
                operands[i].add(node)
            del holders[a, b]
            for p, found in fresh.items():
                holders[p] = found
                if len(found) > 1:
                    heapq.heappush(queue, (-len(found), p))
        return len(self.adds)

    def _chain(self, ops: list[int], base: int) -> int:
        if not ops:
            return -1
        node = ops[0]
        for other in ops[1:]:
            self.adds.append((node, other))
            node = base + len(self.adds) - 1
        return node

    def evaluate(self, impacts: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from the impacts (terms x documents) of single occurrences."""
        leaves = impacts[self.leaf_term] * self.leaf_times[:, None]
        node = np.empty((len(leaves) + len(self.adds), impacts.shape[1]), np.int64)
        node[: len(leaves)] = leaves
        for i, (a, b) in enumerate(self.adds, len(leaves)):
            np.add(node[a], node[b], out=node[i])
        scores = np.zeros((len(self.ends), impacts.shape[1]), np.int64)
        for i, end in enumerate(self.ends):
            if end >= 0:
                scores[i] = node[end]
        return scores


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    k1: float = 0.8,
    b: float = 0.75,
    block_items: int = BLOCK_ITEMS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item by a saturating lexical score.

    With N documents that have a term, L terms in all, n in a document, df documents
    with a term and tf occurrences: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100
    (1 - b) + (100 b n N) div L, and each occurrence of a term in an item adds
    w * ((10^9 tf) div (1000 tf + 10 k1 m)), in 64-bit integers. Only scores over 0
    count; equal ones are ranked by ascending id, null ids last.

    One pass takes the counts of the items' terms out of each whole text and writes
    them; N, L and df are aggregates of that table. A second pass computes the
    partial sums of a ``SharingPlan`` once for each document and keeps the best ``k``
    of every item for each task; only those are shuffled. Items go in blocks of
    about ``block_items`` (and ``block_words`` words), so the plan that is broadcast
    is bounded; more items mean more passes.

    Null texts have no terms, an item without terms gives no rows, equal items (id
    and text) count once, items of one id and different texts are ranked each by
    itself, every row of ``docs`` is a document, other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    id_type, item_type = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("data")).distinct()
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // block_items), -(-size[1] // (8 * block_words)))
    block = F.pmod(F.xxhash64("item_id", "data"), F.lit(blocks))
    asked = scratch.table(asked.withColumn("block", block), "items")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("data"))
    best: DataFrame | None = None
    for turn in range(blocks):
        mine = asked.where(F.col("block") == turn).select("item_id", "data").collect()
        plan = SharingPlan([terms(r["data"]) for r in mine])
        facts = scratch.table(count_terms(texts, plan, id_type), "facts")
        n_docs, length = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in facts.select(F.explode("found").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan.terms))], np.int64)
        top = best_of(facts, plan, weights, n_docs, length, id_type, k, round(10 * k1), round(100 * b))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"item int, item_id {item_type}")
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            ranked = scratch.table(ranked, "ranked")
            scratch.drop(facts)
        best = ranked if best is None else best.unionByName(ranked)
    return best


def count_terms(texts: DataFrame, plan: SharingPlan, id_type: str) -> DataFrame:
    """``doc_id, n, found, times`` of every text with a term: its length and its counts of the plan's terms."""
    shared = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(plan.terms)})

    def make():
        known = shared.value

        def step(columns: list) -> dict:
            out: dict[str, list] = {"doc_id": [], "n": [], "found": [], "times": []}
            for doc_id, data in zip(*columns):
                words = terms(data)
                if words:
                    ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                    found, times = np.unique(ids[ids >= 0], return_counts=True)
                    for name, value in zip(out, (doc_id, len(words), found, times)):
                        out[name].append(value)
            return out

        return step

    return map_rows(texts, make, f"doc_id {id_type}, n long, found array<int>, times array<int>")


def best_of(facts: DataFrame, plan: SharingPlan, weights: np.ndarray, n_docs: int, length: int, id_type: str, k: int, k1: int, b: int) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best documents of every item within each task."""
    spark = facts.sparkSession
    shared = spark.sparkContext.broadcast((plan, weights))
    fields = spark.createDataFrame([], f"item int, doc_id {id_type}, score long").schema
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = shared.value
        n_items, n_terms = len(graph.ends), len(graph.terms)
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                ids, n, found, times = batch.slice(at, DOCS).columns
                m = 100 - b + (b * n.to_numpy() * n_docs) // length
                row = np.repeat(np.arange(len(n)), pc.list_value_length(found).to_numpy())
                term, tf = found.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                impacts = np.zeros((n_terms, len(n)), np.int64)
                impacts[term, row] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + k1 * m[row]))
                scores = graph.evaluate(impacts)
                hits = scores >= least[:, None]
                for item in np.flatnonzero(hits.any(1)).tolist():
                    more = [((-s, d is None, d), d, s) for s, d in ((int(scores[item, j]), ids[j].as_py()) for j in np.flatnonzero(hits[item]).tolist())]
                    best[item] = sorted(best[item] + more, key=lambda x: (x[0][:2], x[0][2] if x[0][2] is not None else 0))[:k]
                    if len(best[item]) == k:
                        least[item] = best[item][-1][2]
        flat = [(i, d, s) for i, found in enumerate(best) for _, d, s in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], f.type) for c, f in enumerate(target)], schema=target)

    return facts.mapInArrow(run, fields)
