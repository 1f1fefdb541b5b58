"""Removal of lines that many sites share, counted with HyperLogLog sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

RSD = 0.12  # relative standard deviation of the sketches: 128 registers for each line that two sites share
SIGMAS = 5.0
GONE, GONE_ROW = "__gone_lines", "__gone_row"  # names that no input column has


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 5,
    min_chars: int = 1,
) -> DataFrame:
    """Removes boilerplate: lines that appear on ``min_sites`` distinct sites or more.

    Every column of ``docs`` is kept; ``text_col`` becomes the text without the
    removed lines, and ``n_lines`` and ``n_removed`` are added (in place of input
    columns of these names). The first
    occurrence of a boilerplate line (smallest id, then text and position) stays,
    so no wording is lost from the corpus.

    Lines are split at newlines and compared by their exact text (128-bit hash);
    lines shorter than ``min_chars`` characters after trimming are left alone. A
    null site is a site of its own; a null text has no lines and stays null; an
    empty text is one short line. Rows of equal id and text are one document that
    came more than once: all of them are treated alike. Null ids are last. The sketch (``RSD``) of each line merges by partial aggregation, so a
    line on a third of all rows is one row per task before the shuffle. Estimates
    within ``SIGMAS`` deviations of the threshold are replaced by exact distinct
    counts of (line, site). Only docs that lose a line have their text rebuilt.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    text = F.col(text_col).cast("string")
    # Rows are known by a digest of id and text: stable however often a lost task reads them again.
    row_key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)))
    hashed = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(F.trim(x)) >= min_chars, F.unhex(F.md5(x))))
    site = F.coalesce(F.xxhash64(F.col(site_col).cast("string")), F.lit(0))
    # The key is made before the lines are listed: a generator repeats what is computed from later for every line.
    keyed = docs.select(row_key.alias("row"), F.col(id_col).alias("doc_id"), site.alias("site"), hashed.alias("hashed"))
    found = keyed.select("row", "doc_id", "site", F.posexplode("hashed").alias("pos", "line"))
    lines = scratch.table(found.where("line IS NOT NULL"), "lines")
    # Lines of one site need no sketch: the least and the greatest site hash tell them apart at the price of two longs.
    spread = lines.groupBy("line").agg(F.min("site").alias("low"), F.max("site").alias("high")).where("low <> high")
    shared = scratch.table(lines.join(spread.select("line"), "line", "left_semi"), "shared") if min_sites > 1 else lines
    sketched = shared.groupBy("line").agg(F.approx_count_distinct("site", RSD).alias("sites"))
    low, high = min_sites * (1 - SIGMAS * RSD), min_sites * (1 + SIGMAS * RSD)
    sketched = scratch.table(sketched.where(F.col("sites") >= low), "sketched")
    near = sketched.where(F.col("sites") <= high).select("line")
    exact = (
        shared.join(near, "line", "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    )
    wide = sketched.where(F.col("sites") > high).select("line").unionByName(exact.select("line"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    marked = scratch.table(shared.join(wide, "line", "left_semi"), "marked")
    first = marked.groupBy("line").agg(F.min(place).alias("first"))
    gone = (
        marked.join(first, "line")
        .where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
        .groupBy(F.col("row").alias(GONE_ROW))
        .agg(F.array_sort(F.collect_set("pos")).alias(GONE))
    )
    gone = scratch.table(gone, "gone")
    scratch.drop(lines, shared, sketched, marked)
    joined = docs.join(gone, row_key == F.col(GONE_ROW), "left")
    kept = F.when(F.col(GONE).isNull(), text).otherwise(F.array_join(without(F.split(text, "\n", -1), F.col(GONE)), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).alias("n_lines"),
        F.coalesce(F.size(F.col(GONE)), F.lit(0)).alias("n_removed"),
    )


def without(items: F.Column, gone: F.Column) -> F.Column:
    """``items`` less the sorted positions ``gone``: the slices between them, so the work is in proportion to the items."""
    # The one-element array binds the split lines to a variable; they are split once and not at each slice.
    def pick(all_items):
        at = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(all_items)))
        part = lambda i: F.slice(all_items, F.get(at, i) + 2, F.get(at, i + 1) - F.get(at, i) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), part))

    return F.get(F.transform(F.array(items), pick), F.lit(0))
