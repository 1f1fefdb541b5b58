"""Unified diffs as relations: files, hunks and changed lines.

A patch is one text, hence one row; its lines are numbered with windows over
that text, so a window never holds more than the row it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Line breaks of a text file and the hunk header of a diff.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
HUNK_HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$"


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)


def _diff_path(line: Column) -> Column:
    path = F.regexp_replace(F.substring(line, F.lit(5), F.length(line)), r"^\s+|\s+$", "")
    return F.when(path.isin("/dev/null", ""), F.lit(None)).otherwise(F.regexp_replace(path, "^[ab]/", ""))


def _marked(lines: DataFrame) -> DataFrame:
    """Adds what the windows need of a line, so that its text is only moved for those who want it.

    ``mark`` is the kind of header a line looks like, else its first character;
    ``head`` is the text of such a header line, NULL for all others.
    """
    line = F.col("line")
    header = (
        F.when(line.startswith("diff --git"), "git")
        .when(line.startswith("--- "), "old")
        .when(line.startswith("+++ "), "new")
        .when(line.rlike(HUNK_HEADER), "hunk")
    )
    return lines.withColumn("mark", F.coalesce(header, F.left(line, F.lit(1)))).withColumn("head", F.when(F.length("mark") > 1, line))


def _tag() -> Column:
    """The first character of a line."""
    mark = F.col("mark")
    return F.when(mark == "git", "d").when(mark == "old", "-").when(mark == "new", "+").when(mark == "hunk", "@").otherwise(mark)


def _inside_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """Adds ``bounded``: a line that looks like a file header but is body, because its hunk still lacks such lines.

    A hunk header says how many old and new lines follow. Between two lines that
    open a file or a hunk, running sums tell how many of each have come; while some
    are missing, ``--- `` is a removed and ``+++ `` an added line. An old file
    header that is none closes the hunk. One window over each patch, no state.
    """
    mark = F.col("mark")
    opens = mark.isin("git", "hunk")
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = lines.withColumn("opened", F.max(F.when(opens, F.col("pos"))).over(upto))
    inside = Window.partitionBy(*keys, "opened").orderBy("pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda i: F.coalesce(F.nullif(F.regexp_extract("head", HUNK_HEADER, i), F.lit("")), F.lit("1")).try_cast("long")
    wanted = lambda i: F.first(F.when(mark == "hunk", count(i))).over(inside)
    tag = _tag()
    body = (F.col("pos") > F.col("opened")) & (tag != "\\")
    came = lambda other: F.coalesce(F.sum((body & (tag != other)).cast("long")).over(before), F.lit(0))
    old = cut.withColumn("lacks_old", F.coalesce(wanted(2) > came("+"), F.lit(False))).withColumn("lacks_new", F.coalesce(wanted(4) > came("-"), F.lit(False)))
    closes = (mark == "old") & ~F.col("lacks_old")
    closed = F.coalesce(F.max(closes.cast("int")).over(before) == 1, F.lit(False))
    is_body = ((mark == "old") & F.col("lacks_old")) | ((mark == "new") & F.col("lacks_new"))
    return old.withColumn("bounded", is_body & ~closed).select(*keys, "pos", "line", "mark", "head", "bounded")


def diff_lines(patches: DataFrame, *keys: str, bounded: bool = True) -> DataFrame:
    """Every line of the diffs in ``patches`` (column ``content``) with its role.

    ``role``: git, old, new (file headers), hunk, added, removed, other. Lines
    carry ``file_ix`` (0 before the first file), ``hunk_ix`` (position of their
    hunk header, NULL outside hunks), and for added/removed lines ``lineno``;
    ``head`` is the text of lines that look like a header.
    While a hunk lacks lines that its header counts, ``--- `` and ``+++ `` are such
    lines; with ``bounded=False`` they always open a file.
    """
    lines = patches.select(*keys, F.posexplode(split_lines(F.col("content"))).alias("pos", "line"))
    lines = _marked(lines)
    lines = _inside_counts(lines, *keys) if bounded else lines.withColumn("bounded", F.lit(False))
    role = F.when(~F.col("bounded") & F.col("head").isNotNull(), F.col("mark"))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_role = lambda name: F.coalesce(F.col("role") == name, F.lit(False))
    numbered = lines.withColumn("role", role).withColumn("n_git", F.sum(is_role("git").cast("int")).over(upto))
    bare_start = F.max((is_role("old") & (F.col("n_git") == 0)).cast("int")).over(upto)
    filed = numbered.withColumn("file_ix", F.col("n_git") + bare_start)
    # A hunk header before any file is plain text.
    ruled = filed.withColumn("role", F.when(~(is_role("hunk") & (F.col("file_ix") == 0)), F.col("role")))
    section = F.max(F.when(F.col("role").isNotNull(), F.col("pos"))).over(upto)
    cut = ruled.withColumn("section", section)
    inside = Window.partitionBy(*keys, "section").orderBy("pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    part = lambda i: F.regexp_extract("head", HUNK_HEADER, i)
    header = lambda i: F.first(F.when(is_role("hunk"), part(i)), ignorenulls=False).over(inside)
    tag = _tag()
    body = F.col("role").isNull() & F.col("in_hunk")
    marked = (
        cut.withColumn("in_hunk", F.first(is_role("hunk")).over(inside))
        .withColumn("tag", tag)
        .withColumn("start_old", header(1))
        .withColumn("start_new", header(3))
    )
    prior = lambda skip: F.coalesce(
        F.sum((body & ~F.col("tag").isin(skip, "\\")).cast("long")).over(before), F.lit(0)
    )
    counted = marked.withColumn("old_no", F.col("start_old").try_cast("long") + prior("+")).withColumn(
        "new_no", F.col("start_new").try_cast("long") + prior("-")
    )
    final_role = (
        F.when(F.col("role").isNotNull(), F.col("role"))
        .when(body & (F.col("tag") == "+"), "added")
        .when(body & (F.col("tag") == "-"), "removed")
        .otherwise("other")
    )
    return counted.select(
        *keys,
        "pos",
        "line",
        "file_ix",
        F.when(F.col("in_hunk"), F.col("section")).alias("hunk_ix"),
        final_role.alias("role"),
        F.when(body & (F.col("tag") == "+"), F.col("new_no"))
        .when(body & (F.col("tag") == "-"), F.col("old_no"))
        .alias("lineno"),
        "head",
    )


def diff_files(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, file_ix, old_path, new_path, is_python``; the last header counts."""
    headers = lines.where("file_ix > 0 and role in ('git', 'old', 'new')")
    path = F.struct(_diff_path(F.col("head")).alias("p"))
    last = lambda role: F.max_by(path, F.when(F.col("role") == role, F.col("pos")))["p"]
    files = headers.groupBy(*keys, "file_ix").agg(last("old").alias("old_path"), last("new").alias("new_path"))
    return files.withColumn(
        "is_python", F.coalesce(F.coalesce("new_path", "old_path").endswith(".py"), F.lit(False))
    )


def diff_hunks(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, file_ix, hunk_ix, old_start, old_count, new_start, new_count, section``."""
    part = lambda i: F.regexp_extract("head", HUNK_HEADER, i)
    count = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("1")).try_cast("long")
    return lines.where("role = 'hunk'").select(
        *keys,
        "file_ix",
        "hunk_ix",
        part(1).try_cast("long").alias("old_start"),
        count(2).alias("old_count"),
        part(3).try_cast("long").alias("new_start"),
        count(4).alias("new_count"),
        part(5).alias("section"),
    )


def diff_changes(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, file_ix, hunk_ix, side, lineno, text`` of added and removed lines."""
    return lines.where("role in ('added', 'removed')").select(
        *keys,
        "file_ix",
        "hunk_ix",
        F.col("role").alias("side"),
        "lineno",
        F.substring("line", F.lit(2), F.length("line")).alias("text"),
    )
