"""Near-duplicate vectors by a forest of random projection trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, components, map_rows

LEAF = 256  # cells of up to this many vectors are not split
BLOCK = 512  # vectors of a leaf that meet in one task at a time


@lru_cache(maxsize=16)
def directions(dim: int, trees: int, levels: int) -> np.ndarray:
    """Random unit directions, one for each tree and level; any task draws the same."""
    drawn = np.random.default_rng([dim, trees, 20240613]).normal(size=(levels, trees, dim))
    return drawn / np.linalg.norm(drawn, axis=2, keepdims=True)


def describe(trees: int, levels: int) -> Callable[[], Callable[[list], dict]]:
    """``mark`` (digest of the values), ``dim`` and the projections of every usable vector; null for the others."""

    def make():
        def step(columns: list) -> dict:
            out: dict[str, list] = {"vec_id": columns[0], "mark": [], "dim": [], "vector": [], "proj": []}
            for values in columns[1]:
                vector = None
                if values and None not in values:
                    vector = np.array(values, float) + 0.0  # no negative zero
                    peak = np.abs(vector).max()
                    vector = vector / peak if np.isfinite(peak) and peak > 0 else None
                if vector is None:
                    for name in ("mark", "dim", "vector", "proj"):
                        out[name].append(None)
                    continue
                vector /= np.linalg.norm(vector)
                projected = np.einsum("ltd,d->tl", directions(len(vector), trees, levels), vector)
                out["mark"].append(blake2b(np.array(values, float).__add__(0.0).tobytes(), digest_size=16).digest())
                out["dim"].append(len(vector))
                out["vector"].append(vector)
                out["proj"].append(projected.astype(np.float32).tolist())
            return out

        return step

    return make


def grow(cells: DataFrame, levels: int, margin: float, scratch: Scratch) -> DataFrame:
    """Splits all cells of all trees level by level; ``dim, tree, node, mark, size`` of the leaves.

    A cell over ``LEAF`` is cut at the median of its vectors' projections on the
    level's direction; vectors within the spill margin go to both sides. A cell
    whose middle two fifths lie within the margin would not get smaller and stays
    a leaf, whatever its size.
    """
    leaves = []
    width = F.lit(margin) / F.sqrt("dim")
    for level in range(levels):
        at = cells.select("dim", "tree", "node", "mark", "proj", F.get("proj", F.lit(level)).alias("p"))
        stats = at.groupBy("dim", "tree", "node").agg(
            F.count(F.lit(1)).alias("size"), F.percentile_approx("p", [0.3, 0.5, 0.7], 500).alias("q")
        )
        splits = (F.col("size") > LEAF) & (F.get("q", F.lit(2)) - F.get("q", F.lit(0)) > 2 * width)
        stats = stats.select("dim", "tree", "node", "size", splits.alias("splits"), F.get("q", F.lit(1)).alias("median"))
        placed = scratch.table(at.join(stats, ["dim", "tree", "node"]), "cells")
        scratch.drop(cells)
        leaves.append(placed.where("NOT splits").select("dim", "tree", "node", "mark", "size"))
        sides = F.filter(
            F.array(
                F.when(F.col("p") <= F.col("median") + width, F.col("node") * 2),
                F.when(F.col("p") > F.col("median") - width, F.col("node") * 2 + 1),
            ),
            lambda side: side.isNotNull(),
        )
        cells = placed.where("splits").select("dim", "tree", F.explode(sides).alias("node"), "mark", "proj")
        if cells.isEmpty():
            break
    else:
        sized = cells.groupBy("dim", "tree", "node").agg(F.count(F.lit(1)).alias("size"))
        leaves.append(cells.join(sized, ["dim", "tree", "node"]).select("dim", "tree", "node", "mark", "size"))
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return found


def compare_leaves(leaves: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Linked pairs ``a < b`` with the copies of each, every pair once; vectors meet within leaves only."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = leaves.withColumn("own", F.pmod(F.xxhash64("mark"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "dim", "tree", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "mark"
    ).join(nodes.select("mark", "copies", "vector"), "mark")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["own"] == key[3]], group[group["own"] == key[4]]
        out = pd.DataFrame({"a": [], "b": [], "a_copies": [], "b_copies": []})
        if not len(left) or not len(right):
            return out
        cosine = np.stack(left["vector"].to_numpy()) @ np.stack(right["vector"].to_numpy()).T
        rows, cols = np.nonzero(cosine >= threshold)
        a, b = left["mark"].to_numpy()[rows], right["mark"].to_numpy()[cols]
        ac, bc = left["copies"].to_numpy()[rows], right["copies"].to_numpy()[cols]
        swap = a > b
        differ = a != b
        out = pd.DataFrame(
            {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "a_copies": np.where(swap, bc, ac), "b_copies": np.where(swap, ac, bc)}
        )[differ]
        return out.drop_duplicates(["a", "b"])

    schema = "a binary, b binary, a_copies long, b_copies long"
    met = dealt.groupBy("dim", "tree", "node", "x", "y").applyInPandas(compare, schema)
    return met.groupBy("a", "b").agg(F.max("a_copies").alias("a_copies"), F.max("b_copies").alias("b_copies"))


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    trees: int = 8,
    spill: float = 0.5,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, in double precision.

    Links are pairs of rows with a cosine of ``threshold`` or more that share a
    leaf in one of ``trees`` trees; every link is verified, so none lies below.
    The spill margin on either side of a cut is ``spill`` standard deviations of
    the difference that two vectors at the threshold have along a random
    direction; with the defaults a pair right at the threshold is missed by all
    trees less than once in 10,000, and closer ones far more rarely.

    Equal vectors are one node with a count of copies, so a third of all rows
    being one vector costs one row per task. Vectors that are null, empty, zero,
    or have null or non-finite components link with nothing, as do vectors of
    different length. ``component_id`` is the smallest id reachable by links,
    ``kept`` says that it is the row's own. Repeated rows count as copies, rows
    with a null id take part and are named by their component. Extra columns are
    not read; an empty table gives an empty result. The forest holds about
    ``trees`` times 1.13 to the power of the depth rows of digests and numbers;
    the vectors themselves are shuffled once, to the leaves.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    n = vectors.count()
    levels = max(1, ceil(1.5 * log2(max(2.0, n / LEAF))) + 2)
    margin = spill * sqrt(2 - 2 * threshold)
    id_type = dict(vectors.dtypes)[id_col]
    schema = f"vec_id {id_type}, mark binary, dim int, vector array<double>, proj array<array<float>>"
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = scratch.table(map_rows(read, describe(trees, levels), schema), "rows")
    usable = rows.where("mark IS NOT NULL")
    nodes = scratch.table(
        usable.groupBy("mark").agg(
            F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.first("proj").alias("proj")
        ),
        "nodes",
    )
    planted = nodes.select("dim", F.posexplode("proj").alias("tree", "proj"), F.lit(1).cast("long").alias("node"), "mark")
    leaves = grow(planted.select("dim", "tree", "node", "mark", "proj"), levels, margin, scratch)
    links = scratch.table(compare_leaves(leaves, nodes, threshold), "links")
    ends = links.select(F.col("a").alias("mark"), F.col("b_copies").alias("others")).unionAll(links.select("b", "a_copies"))
    linked = ends.groupBy("mark").agg(F.sum("others").alias("others"))
    classes = components(links, scratch, "a", "b").withColumnRenamed("node", "mark")
    placed = (
        rows.select("vec_id", "mark")
        .join(nodes.select("mark", "copies"), "mark", "left")
        .join(linked, "mark", "left")
        .join(classes, "mark", "left")
        .select("vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "mark").alias("component"))
    )
    named = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    done = placed.join(named, "component", "left").withColumn(
        "component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    )
    return done.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
