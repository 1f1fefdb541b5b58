"""Helpers shared by the operators: scratch tables, samples, components, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_dir, ship_package

# Spark 4 offers the bytes limit of Arrow batches; rows alone would let very long texts pile up.
SLICE_ROWS = 256


class Scratch:
    """Tables in the shared folder that stand for cut lineage.

    A written table outlives lost executors and is re-read by any of them. Those
    that no later step reads are removed with ``drop``; the rest belong to the
    returned DataFrame and stay until the folder of the session is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.made = 0

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made:04d}-{tag}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self.__dict__.setdefault("_held", []).append(back)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit_hash(*columns: str | Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def sample_by_class(rows: DataFrame, label: str, per_class: int, max_classes: int = 1024) -> DataFrame:
    """About ``per_class`` rows of every class, drawn by a hash of the row; all of a smaller class.

    ``rows`` holds distinct keys and labels only, never texts. The result has
    about ``per_class`` times the number of classes rows whatever the size of
    the input, so it may be broadcast. Rows without a label are not drawn. The
    counts, one row for each class, go to the rows, which are not shuffled. More
    than ``max_classes`` classes are an error: the models grow with their number.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if counts.limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}; give max_classes, and memory, for more")
    draw = unit_hash(*[F.col(c) for c in rows.columns])
    return rows.join(F.broadcast(counts), label).where(draw < F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("__n"))).select(rows.columns)


def one_text_each(texts: DataFrame, drawn: DataFrame, label: str) -> DataFrame:
    """``doc_id``, label and one text of each drawn id, the one of least digest, however many rows the id has.

    If ``texts`` has the label too, a text is only learned with the label of its own row.
    """
    on = ["doc_id", label] if label in texts.columns else ["doc_id"]
    return texts.join(F.broadcast(drawn), on).groupBy("doc_id", label).agg(F.min_by("text", F.md5("text")).alias("text"))


def components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every node with an edge; a component is named by its smallest node.

    Each round every root hooks to its smallest neighbour, pointers are doubled
    once, and the edges are re-written between roots. Nodes fall at least by half
    in each round; only per-key minima are gathered, never neighbour lists.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    live = scratch.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label: DataFrame | None = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        low = both.groupBy("node").agg(F.min("other").alias("m"))
        hook = scratch.table(low.select("node", F.least("node", "m").alias("up")), "hook")
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        flat = scratch.table(
            hook.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "flat"
        )
        scratch.drop(hook)
        if label is None:
            moved = flat.select("node", F.col("up").alias("component"))
        else:
            moved = (
                label.join(flat.select(F.col("node").alias("component"), "up"), "component", "left")
                .select("node", F.coalesce("up", "component").alias("component"))
            )
        moved = scratch.table(moved, "labels")
        to_a = flat.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        to_b = flat.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        between = live.join(to_a, "a").join(to_b, "b").where("ua <> ub")
        next_live = scratch.table(
            between.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges"
        )
        scratch.drop(*([label] if label is not None else []), live, flat)
        label, live = moved, next_live
    scratch.drop(live)
    if label is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Applies a function of column lists to slices of rows inside the tasks.

    ``make`` runs once per task and returns a function from a list of columns
    (each a Python list) to a dict of output columns, so that tables and memos
    are set up once. Slices hold ``SLICE_ROWS`` rows, which bounds what is
    unpacked at a time. Where a function needs whole groups, use another way.
    """
    ship_package(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = step([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, fields)
