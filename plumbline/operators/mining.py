"""Which functions did a fixing patch change?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import leaf, path_suffixes
from plumbline.operators.diff import diff_changes, diff_files, diff_hunks, diff_lines

# Lines per bin of the line-in-span join.
BIN = 128
# Fixed value: a definition in the section text of a hunk header.
DEFINITION = r"(?U)\b(?:def|class)\s+(\w+)"


def innermost_spans(lines: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """``keys, lineno, symbol``: the smallest span around each line.

    A span is listed in each bin of lines it touches, so lines only meet the
    spans of their own neighbourhood instead of every span of the file.
    """
    bins = F.sequence(F.floor(F.col("line") / BIN), F.floor(F.col("end_line") / BIN))
    placed = spans.select(*keys, "line", "end_line", F.col("owner").alias("symbol"), F.explode(bins).alias("bin"))
    asked = lines.select(*keys, "lineno").distinct().withColumn("bin", F.floor(F.col("lineno") / BIN))
    return (
        asked.join(placed, [*keys, "bin"])
        .where(F.col("lineno").between(F.col("line"), F.col("end_line")))
        .groupBy(*keys, "lineno")
        .agg(F.min(F.struct((F.col("end_line") - F.col("line")).alias("size"), "symbol"))["symbol"].alias("symbol"))
    )


def header_symbols(hunks: DataFrame, *keys: str) -> DataFrame:
    """``keys, file_ix, symbol`` named in hunk headers."""
    found = F.regexp_extract("section", DEFINITION, 1)
    return hunks.select(*keys, "file_ix", found.alias("symbol")).where("symbol <> ''").distinct()


def mine_patches(patches: DataFrame, spans: DataFrame | None = None, keys: tuple[str, ...] = ("advisory",)) -> DataFrame:
    """``keys, path, qualified, short, method`` for every patched Python symbol.

    ``keys`` tell patch texts apart: an advisory with several patches needs the
    patch among them, because lines are numbered within one text.

    With ``spans`` (``path, line, end_line, owner`` of post-image sources) added
    lines are mapped to their innermost definition; a file for which that gives
    nothing falls back to the hunk headers.
    """
    lines = diff_lines(patches, *keys)
    files = diff_files(lines, *keys).where("is_python").withColumn("path", F.coalesce("new_path", "old_path"))
    by_header = header_symbols(diff_hunks(lines, *keys), *keys).join(files.select(*keys, "file_ix", "path"), [*keys, "file_ix"])
    header_rows = by_header.select(*keys, "file_ix", "path", "symbol", F.lit("hunk-header").alias("method"))
    if spans is None:
        found = header_rows
    else:
        offered = files.select(*keys, "file_ix", "path", F.posexplode(path_suffixes(F.col("path"))).alias("n", "source_path"))
        have = spans.select(F.col("path").alias("source_path")).distinct()
        chosen = (
            offered.join(have, "source_path", "left_semi")
            .groupBy(*keys, "file_ix", "path")
            .agg(F.min_by("source_path", "n").alias("source_path"))
        )
        added = diff_changes(lines, *keys).where("side = 'added'")
        asked = added.join(chosen, [*keys, "file_ix"]).select("source_path", "lineno", *keys, "file_ix", "path")
        hit = innermost_spans(asked, spans.withColumnRenamed("path", "source_path"), "source_path")
        ast_rows = (
            asked.join(hit, ["source_path", "lineno"])
            .select(*keys, "file_ix", "path", "symbol", F.lit("ast").alias("method"))
            .distinct()
        )
        found = ast_rows.unionByName(header_rows.join(ast_rows.select(*keys, "file_ix").distinct(), [*keys, "file_ix"], "left_anti"))
    return found.select(*keys, "path", F.col("symbol").alias("qualified"), leaf(F.col("symbol")).alias("short"), "method").distinct()


def mined_symbols(mined: DataFrame, index: DataFrame, source: str = "seed-patch") -> DataFrame:
    """Rows of the mined-symbol table: one per affected package and symbol.

    ``index``: ``vuln_id, ecosystem, name`` of known advisories; patches of
    unknown advisories drop out.
    """
    names = mined.select("advisory", F.explode(F.array(F.struct("short", "qualified"), F.struct("short", F.col("short").alias("qualified")))).alias("s"))
    return (
        names.select(F.col("advisory").alias("vuln_id"), F.col("s.short").alias("symbol"), "s.qualified")
        .distinct()
        .join(index.select("vuln_id", "ecosystem", "name").distinct(), "vuln_id")
        .select("vuln_id", "ecosystem", "name", "symbol", "qualified", F.lit(source).alias("source"))
    )


def replace_mined(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored symbols with those of the same (advisory, package, source) replaced."""
    keys = ["vuln_id", "ecosystem", "name", "source"]
    kept = stored.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh)
