"""Hard negatives of anchor vectors by exact inner products, found in STR-packed R-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

LIMIT = 1 << 26  # a quantised component lies within it, so that 2048 products fit 64 bits
TILE = 8192  # rows of one tree
LEAF = 64  # rows of a leaf
FAN = 16  # children of an inner node
CUTS = 3  # coordinates by which a tile is cut after its labels
TILES = 16  # trees that one task searches, one after the other
ANCHORS = 8192  # anchors that one task holds
NONE = np.iinfo(np.int64).min


def str_order(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: slabs by label, each cut into slabs of the widest coordinate, and so on."""
    spread = vectors.var(0) if len(vectors) else np.zeros(0)
    keys = [labels, *(vectors[:, c] for c in np.argsort(-spread, kind="stable")[:CUTS])]
    leaves = -(-len(labels) // LEAF)
    slabs = max(1, round(leaves ** (1 / len(keys)) + 0.49))

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(keys[depth][rows], kind="stable")]
        if depth == len(keys) - 1 or len(rows) <= LEAF:
            return [rows]
        size = LEAF * max(1, -(-len(rows) // (slabs * LEAF)))
        return [x for at in range(0, len(rows), size) for x in cut(rows[at : at + size], depth + 1)]

    return np.concatenate(cut(np.arange(len(labels)), 0)) if len(labels) else np.zeros(0, np.int64)


class Tree:
    """Boxes over consecutive leaves and, level by level, over ``FAN`` boxes each, up to one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.levels = []
        low, high, first, last, step = vectors, vectors, labels, labels, LEAF
        while True:
            at = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
            step = FAN
            if len(low) == 1:
                break

    def children(self, level: int, node: int) -> slice:
        step = FAN if level else LEAF
        size = len(self.levels[level - 1][0]) if level else len(self.ids)
        return slice(node * step, min((node + 1) * step, size))


class Best:
    """The ``k`` best rows of every window of every anchor so far, best first; ties by the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), NONE)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def open(self, who: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether scores between ``least`` and ``most`` may still enter a window: not beside it, not strictly below its kth."""
        need = np.maximum(self.low[who], self.scores[who, :, -1])
        return ((most[:, None] >= need) & (least[:, None] <= self.high[who])).any(1)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            need = np.maximum(self.low[who, w], self.scores[who, w, -1])
            good = allowed & (scores >= need[:, None]) & (scores <= self.high[who, w, None])
            at = np.flatnonzero(good.any(1))
            if not len(at):
                continue
            rows = who[at]
            s = np.concatenate([self.scores[rows, w], np.where(good[at], scores[at], NONE)], 1)
            i = np.concatenate([self.ids[rows, w], np.broadcast_to(ids, (len(at), len(ids)))], 1)
            order = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, : self.k]
            self.scores[rows, w] = np.take_along_axis(s, order, 1)
            self.ids[rows, w] = np.take_along_axis(i, order, 1)


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, best: Best) -> None:
    """Best-first search of one tree for all anchors together.

    A box bounds the inner product coordinate by coordinate: a positive component
    of the anchor takes the box's upper end for the most and its lower end for the
    least, a negative one the other way round. The queue gives the box with the
    highest upper bound of any anchor; only the anchors for which it is still open go down.
    """
    kind = vectors.dtype
    points = tree.vectors.astype(kind)
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    tick = count()
    queue: list = []

    def push(level: int, nodes: slice, who: np.ndarray) -> None:
        low, high, first, last = (x[nodes] for x in tree.levels[level])
        low, high = low.astype(kind), high.astype(kind)
        most = (up[who] @ high.T + down[who] @ low.T).astype(np.int64)
        least = (up[who] @ low.T + down[who] @ high.T).astype(np.int64)
        mine = labels[who, None]
        fits = (first <= mine) & (mine <= last) if same else (first != last) | (mine != first)
        for j in range(len(low)):
            alive = np.flatnonzero(fits[:, j])
            alive = alive[best.open(who[alive], least[alive, j], most[alive, j])]
            if len(alive):
                heapq.heappush(queue, (-int(most[alive, j].max()), next(tick), level, nodes.start + j, who[alive], least[alive, j], most[alive, j]))

    push(len(tree.levels) - 1, slice(0, 1), np.arange(len(ids)))
    while queue:
        _, _, level, node, who, least, most = heapq.heappop(queue)
        who = who[best.open(who, least, most)]
        if not len(who):
            continue
        below = tree.children(level, node)
        if level:
            push(level - 1, below, who)
            continue
        scores = (vectors[who] @ points[below].T).astype(np.int64)
        equal = labels[who, None] == tree.labels[below]
        best.add(who, scores, tree.ids[below], (equal if same else ~equal) & (ids[who, None] != tree.ids[below]))


def matrix(rows: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of ``dims`` columns; what a shorter list lacks is 0."""
    sizes = rows.value_lengths().to_numpy()
    out = np.zeros((len(rows), dims), np.int32)
    out[np.arange(dims) < sizes[:, None]] = rows.flatten().to_numpy()
    return out


def pack_tiles(dims: int):
    """Rows of a partition as trees of at most ``TILE`` rows, each one row of three packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = TaskContext.get().partitionId() // TILES

        def tile() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
            vectors = matrix(table.column("q").combine_chunks(), dims)
            order = str_order(vectors, labels)
            packed = [ids[order].tobytes(), labels[order].tobytes(), vectors[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["part", "ids", "labels", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                piece = batch.slice(at, TILE)
                if held and sum(b.num_rows for b in held) + piece.num_rows > TILE:
                    yield tile()
                    held.clear()
                held.append(piece)
        if sum(b.num_rows for b in held):
            yield tile()

    return run


def searcher(dims: int, same: bool, k: int, windows: int):
    """A function of anchors and tiles of one cell; gives ``anchor, slot, id, score`` of the best rows of each window."""

    def run(anchors: pa.Table, tiles: pa.Table) -> pa.Table:
        names = ["anchor_id", "slot", "id", "score"]
        ids, labels = (anchors.column(c).to_numpy() for c in ("id", "label"))
        vectors = matrix(anchors.column("q").combine_chunks(), dims)
        low = np.full((len(ids), windows), np.iinfo(np.int64).max)
        high = np.full((len(ids), windows), NONE)
        for i, found in enumerate(anchors.column("windows").to_pylist()):
            for w, (a, b) in enumerate((x["low"], x["high"]) for x in found):
                low[i, w], high[i, w] = a, b
        best = Best(low, high, k)
        if len(ids):
            top = int(np.abs(vectors).max(initial=0))
            for j in range(tiles.num_rows):
                tree_ids, tree_labels = (np.frombuffer(tiles.column(c)[j].as_py(), np.int64) for c in ("ids", "labels"))
                packed = np.frombuffer(tiles.column("vectors")[j].as_py(), np.int32).reshape(len(tree_ids), dims)
                # Doubles are exact below 2^53 and multiply faster; beyond, whole numbers do.
                kind = np.float64 if top * int(np.abs(packed).max(initial=0)) * dims < 1 << 53 else np.int64
                search(Tree(tree_ids, tree_labels, packed), ids, labels, vectors.astype(kind), same, best)
        i, w, r = np.nonzero(best.scores > NONE)
        return pa.table([pa.array(ids[i]), pa.array(w.astype(np.int32)), pa.array(best.ids[i, w, r]), pa.array(best.scores[i, w, r])], names)

    return run


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all rows where ``anchor`` holds.

    Components become floor(scale * x). Of the rows of the anchor's label the
    ``positives`` with the highest integer inner product are its positives; for each
    of them the ``negatives`` highest rows of other labels count whose score is at
    most the positive's and at least ``share`` of it (share[0] * positive <=
    share[1] * negative). Ties go to the smaller id.

    Rows are range-partitioned by label and coordinate, with a hash of the id
    among equals so that no value makes a large part, and packed into trees of at
    most ``TILE`` rows. Anchors meet the trees in cells of ``ANCHORS`` by ``TILES``
    trees: the stated query set against all rows, in blocks; a cell sends
    its best rows only. Of equal vectors of one label, the smallest ids can alone be
    among the best, so only ``positives`` + 1 (``negatives``, if more) of each are indexed.

    No part is taken by rows with a null id, label or vector, with a null or
    non-finite component, or with a quantised one beyond 2^26, whose products might
    leave 64 bits. A shorter vector counts as filled up with 0. Of rows with one id
    the least (label, vector) stands. Ids and labels are whole numbers. Empty tables
    give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardnegatives")
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    fine = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < float(LIMIT)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), scaled.cast("array<int>").alias("q")).alias("row"), anchor.alias("asks")
    )
    rows = scratch.table(rows.groupBy("id").agg(F.min("row").alias("row"), F.max("asks").alias("asks")).select("id", "row.label", "row.q", "asks"), "rows")
    n, asking, dims = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    dims = max(1, dims)
    same_vector = Window.partitionBy("label", "q").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(same_vector)).where(F.col("nth") <= max(positives + 1, negatives))
    parts = max(1, -(-n // TILE))
    dealt = few.select("id", "label", "q").repartitionByRange(parts, "label", F.try_element_at("q", F.lit(1)), F.xxhash64("id"))
    tiles = scratch.table(dealt.mapInArrow(pack_tiles(dims), "part long, ids binary, labels binary, vectors binary"), "tiles")
    groups = (tiles.agg(F.max("part")).first()[0] or 0) + 1
    crowds = max(1, -(-asking // ANCHORS))

    def cells(anchors: DataFrame, same: bool, k: int, windows: int) -> DataFrame:
        """The ``k`` best rows of each window over all cells: ``anchor_id, slot, id, score, rank``."""
        left = anchors.withColumn("crowd", F.pmod(F.xxhash64("id"), F.lit(crowds)))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        right = tiles.withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(crowds - 1).cast("long"))))
        found = left.groupBy("crowd", "part").cogroup(right.groupBy("crowd", "part")).applyInArrow(searcher(dims, same, k, windows), "anchor_id long, slot int, id long, score long")
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    whole = F.array(F.struct(F.lit(NONE + 1).alias("low"), F.lit(-(NONE + 1)).alias("high")))
    asked = rows.where("asks").select("id", "label", "q", whole.alias("windows"))
    near = scratch.table(cells(asked, True, positives, 1).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
    # ceil(share * score) in whole numbers: the least score of a negative.
    least = F.expr(f"-((-{share[0]}L * positive_score - pmod(-{share[0]}L * positive_score, {share[1]}L)) div {share[1]}L)")
    windows = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", least.alias("low"), F.col("positive_score").alias("high")))), lambda x: F.struct(x["low"], x["high"])).alias("windows"))
    asked = rows.where("asks").select("id", "label", "q").join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "q", "windows")
    far = cells(asked, False, negatives, positives)
    return far.join(near, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
