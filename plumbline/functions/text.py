"""Small text helpers shared by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")


def leaf(dotted: Column) -> Column:
    """``a.b.c`` -> ``c``."""
    return F.substring_index(dotted, ".", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def truncate(text: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last one an ellipsis."""
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))
    )


def pad(text: Column, width: int) -> Column:
    return F.rpad(truncate(text, width), width, " ")


def percent(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def lossy_utf8(content: Column) -> Column:
    """Decode bytes as UTF-8, replacing what is not valid."""
    return F.make_valid_utf8(content.cast("string"))


def path_suffixes(path: Column) -> Column:
    """``a/b/c.py`` -> [``a/b/c.py``, ``b/c.py``, ``c.py``]."""
    return let(
        F.split(path, "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
        ),
    )


def module_name(relative_path: Column) -> Column:
    """Dotted module for a source path relative to its project root."""
    bare = F.regexp_replace(relative_path, r"\.py$", "")
    named = F.filter(F.split(bare, "/"), lambda part: part != "__init__")
    return F.when(F.size(named) == 0, F.lit("__init__")).otherwise(F.array_join(named, "."))


def exact_round(x: Column, digits: int) -> Column:
    """Round a double half-to-even on its exact binary value.

    SQL ``round`` and ``bround`` work on the shortest decimal form, so 0.15
    becomes 0.2 although the stored number is below the midpoint. Here the
    product with 2*10^digits is formed together with its rounding error, which
    tells on which side of the midpoint the stored number lies. (The factor has
    few bits, so splitting ``x`` alone makes the partial products exact.) Only
    midpoints take that detour.
    """
    factor = F.lit(float(2 * 10**digits))

    def at_midpoint(v: Column) -> Column:
        wide = v["x"] * F.lit(134217729.0)
        hi = wide - (wide - v["x"])
        err = (v["x"] - hi) * factor - (v["p"] - hi * factor)
        half = v["p"] / 2
        return F.when(err > 0, half + 0.5).when(err < 0, half - 0.5).otherwise(F.rint(half))

    p = x * factor
    detour = let(F.struct(x.alias("x"), p.alias("p")), at_midpoint)
    return F.when(F.abs(p % 2) == 1, detour).otherwise(F.rint(p / 2)) / F.lit(float(10**digits))
