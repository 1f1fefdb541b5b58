"""Source trees, including the names Spark's own file sources hide.

Spark skips files and folders whose names start with ``_`` or ``.``, so it never
sees ``__init__.py`` or ``.venv``. Here tasks walk the folders in rounds: one that
has met enough entries hands the folders it has not opened back, and the next
round deals them over all tasks, so no folder is one task's alone. The listing is
a table; filters on it decide which files are opened at all, and those are dealt
by their number and size. No folder is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import lossy_utf8
from plumbline.session import PARSE_BYTES, materialize

UNITS = pa.schema([("unit", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64())])
ENTRIES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("error", pa.string()), ("is_dir", pa.bool_())])
CONTENTS = pa.schema([("path", pa.string()), ("value", pa.binary()), ("error", pa.string())])
FOLDERS_PER_TASK, FILES_PER_TASK = 64, 4096
# Entries a task meets before it hands folders back: few in the first round, which is a single task.
FIRST_ENTRIES, ROUND_ENTRIES = 256, 16384


def list_root(spark: SparkSession, root: str) -> DataFrame:
    """``unit, is_dir, size`` of the entries right below ``root``, listed by one task."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                store, base = pafs.FileSystem.from_uri(root)
                found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e.path for e in found], pa.string()),
                        pa.array([e.type == pafs.FileType.Directory for e in found], pa.bool_()),
                        pa.array([e.size or 0 for e in found], pa.int64()),
                    ],
                    schema=UNITS,
                )

    return spark.range(1, numPartitions=1).mapInArrow(entries, "unit string, is_dir boolean, size long")


def _problem(error: OSError) -> str:
    return f"{type(error).__name__}: {error.strerror or error}"


def _walk(root: str, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists the folders of a batch and what lies below, up to about ``entries`` entries; the rest comes back unopened."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        top = top.rstrip("/")

        def rows(paths: list[str], sizes: list[int], error: str | None, is_dir: bool) -> pa.RecordBatch:
            n = len(paths)
            return pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([error] * n, pa.string()), pa.array([is_dir] * n, pa.bool_())],
                schema=ENTRIES,
            )

        for batch in batches:
            folders, met = batch.column(0).to_pylist(), 0
            while folders and met < entries:
                folder = folders.pop()
                try:
                    found = store.get_file_info(pafs.FileSelector(f"{top}/{folder}", allow_not_found=folder == ""))
                except OSError as problem:
                    yield rows([folder], [0], _problem(problem), False)
                    continue
                met += len(found)
                folders += [f.path[len(top) + 1 :] for f in found if f.type == pafs.FileType.Directory]
                files = [f for f in found if f.type != pafs.FileType.Directory]
                yield rows([f.path[len(top) + 1 :] for f in files], [f.size or 0 for f in files], None, False)
            yield rows(folders, [0] * len(folders), None, True)

    return walk


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``path, size, error`` of all files below ``root``, paths relative to it; no file is opened.

    ``root`` is an absolute path or a URI that every executor can read. A folder
    that cannot be listed is a row with its ``error``. The rows are written, so
    that filters on them are cheap and cost no second walk.
    """
    folders, tasks, entries, rounds = spark.range(1).select(F.lit("").alias("path")), 1, FIRST_ENTRIES, []
    while True:
        walked = folders.repartition(tasks, "path").mapInArrow(_walk(root, entries), "path string, size long, error string, is_dir boolean")
        walked = materialize(walked, "listed")
        rounds.append(walked.where("not is_dir"))
        folders = walked.where("is_dir").select("path")
        left = folders.count()
        if not left:
            return reduce(DataFrame.unionByName, rounds).drop("is_dir")
        tasks = max(ceil(left / FOLDERS_PER_TASK), min(left, spark.sparkContext.defaultParallelism))
        entries = ROUND_ENTRIES


def read_listed(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """Rows ``path, value, error``: the bytes of the files of ``listing``, and of no others.

    A file that cannot be read is a row with its ``error`` and no value; rows of
    the listing that have an error are passed on.
    """

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = None
                if error is None:
                    try:
                        with store.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
                            value = stream.read()
                    except OSError as problem:
                        error = _problem(problem)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), pa.array([value], pa.binary()), pa.array([error], pa.string())], schema=CONTENTS
                )

    size = listing.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(ceil(size.n / FILES_PER_TASK), ceil(size.bytes / PARSE_BYTES), 1)
    tasks = max(tasks, min(size.n, spark.sparkContext.defaultParallelism))
    return listing.select("path", "error").repartition(tasks, "path").mapInArrow(read_files, "path string, value binary, error string")


def read_tree(spark: SparkSession, root: str, suffix: str = ".py", listing: DataFrame | None = None) -> DataFrame:
    """Rows ``path, content, error`` of the files below ``root`` with this suffix; folders that cannot be listed are rows too.

    ``listing`` is what ``list_tree`` gave, all of it or the part to be read.
    """
    listed = list_tree(spark, root) if listing is None else listing
    contents = read_listed(spark, root, listed.where(F.col("path").endswith(suffix) | F.col("error").isNotNull()))
    return contents.select("path", lossy_utf8(F.col("value")).alias("content"), "error")
