"""PEP 440 version order as a sortable string key.

``version_key`` maps a version to text whose plain byte order is the PEP 440
order, so versions can be compared, sorted, joined, grouped and min/max-ed with
ordinary Spark operators, and the key keeps useful parquet statistics. Numbers
carry their digit count in front, so they may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let

_MARK = "\u0001"

# The PEP 440 grammar (appendix B of the PEP), groups in order
# epoch, release, pre tag, pre number, implicit post number, post tag,
# post number, dev tag, dev number, local.
PEP440 = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
EPOCH, RELEASE, PRE, PRE_N, POST_BARE, POST, POST_N, DEV, DEV_N, LOCAL = range(1, 11)


def _groups(version: Column) -> Column:
    """The ten grammar groups as an array (index 0 unused), NULL if invalid.

    One regex pass: the match is rewritten to its groups and split.
    """
    rewritten = F.regexp_replace(
        version, PEP440, "".join(f"{_MARK}${i}" for i in range(1, 11))
    )
    return let(
        rewritten,
        lambda r: F.when(r.startswith(_MARK) & ~version.contains(_MARK), F.split(r, _MARK, -1)),
    )


def _counted(bare: Column) -> Column:
    size = F.length(bare).cast("string")
    return F.concat(F.when(F.length(bare) < 10, F.concat(F.lit("000"), size)).otherwise(F.lpad(size, 4, "0")), bare)


def _number(digits: Column) -> Column:
    # Trimming costs more than all else here, and few numbers need it.
    return F.when(digits == "", F.lit("0000")).when(digits.startswith("0"), _counted(F.ltrim(digits, F.lit("0")))).otherwise(_counted(digits))


def _release(text: Column) -> Column:
    # Only a release that ends in a 0 can end in parts that are 0.
    trimmed = F.when(text.endswith("0"), F.regexp_replace(text, r"(?:^|\.)0+(?:\.0+)*$", "")).otherwise(text)

    def joined(bare: Column) -> Column:
        parts = F.transform(F.split(bare, r"\."), lambda part: F.concat(F.lit("1"), _number(part)))
        return F.when(bare == "", F.lit("0")).otherwise(F.concat(F.array_join(parts, ""), F.lit("0")))

    return let(trimmed, joined)


def _pre(g: Column) -> Column:
    tag = g[PRE]
    code = F.when(tag.startswith("a") | tag.startswith("A"), "a").when(tag.startswith("b") | tag.startswith("B"), "b").otherwise("r")
    bare_dev = (g[POST] == "") & (g[POST_BARE] == "") & (g[DEV] != "")
    return (
        F.when(tag != "", F.concat(F.lit("1"), code, _number(g[PRE_N])))
        .when(bare_dev, F.lit("0"))
        .otherwise(F.lit("2"))
    )


def _post(g: Column) -> Column:
    present = (g[POST] != "") | (g[POST_BARE] != "")
    return F.when(
        present, F.concat(F.lit("1"), _number(F.concat(g[POST_BARE], g[POST_N])))
    ).otherwise(F.lit("0"))


def _dev(g: Column) -> Column:
    return F.when(g[DEV] != "", F.concat(F.lit("0"), _number(g[DEV_N]))).otherwise(F.lit("1"))


def _local(g: Column) -> Column:
    parts = F.transform(
        F.split(F.lower(g[LOCAL]), "[._-]"),
        lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("11"), _number(s))).otherwise(
            F.concat(F.lit("10"), s, F.lit("!"))
        ),
    )
    return F.when(
        g[LOCAL] != "", F.concat(F.lit("1"), F.array_join(parts, ""), F.lit("0"))
    ).otherwise(F.lit("0"))


def _key(g: Column) -> Column:
    return F.concat(_number(g[EPOCH]), _release(g[RELEASE]), _pre(g), _post(g), _dev(g), _local(g))


def _base(g: Column) -> Column:
    def plain(n: Column) -> Column:
        bare = F.ltrim(n, F.lit("0"))
        return F.when(bare == "", F.lit("0")).otherwise(bare)

    release = F.array_join(F.transform(F.split(g[RELEASE], r"\."), plain), ".")
    has_epoch = F.ltrim(g[EPOCH], F.lit("0")) != ""
    return F.when(has_epoch, F.concat(plain(g[EPOCH]), F.lit("!"), release)).otherwise(release)


def is_version(version: Column) -> Column:
    """Is the text a valid version (false for NULL)?"""
    return F.coalesce(version.rlike(PEP440), F.lit(False))


def version_key(version: Column) -> Column:
    """Sortable key of a version, NULL when the text is not a valid version."""
    return let(_groups(version), lambda g: F.when(g.isNotNull(), _key(g)))


def version_facts(version: Column) -> Column:
    """Struct of key, is_prerelease, is_postrelease and base_version."""
    return let(
        _groups(version),
        lambda g: F.when(
            g.isNotNull(),
            F.struct(
                _key(g).alias("vkey"),
                ((g[PRE] != "") | (g[DEV] != "")).alias("is_prerelease"),
                ((g[POST] != "") | (g[POST_BARE] != "")).alias("is_postrelease"),
                _base(g).alias("base_version"),
            ),
        ),
    )


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1; NULL when either side is not a version."""
    return let(
        F.struct(version_key(left).alias("a"), version_key(right).alias("b")),
        lambda k: F.when(k["a"] < k["b"], -1).when(k["a"] == k["b"], 0).when(k["a"] > k["b"], 1),
    )


def sort_versions(versions: Column) -> Column:
    """Valid versions of an array in version order (ties by text)."""
    keyed = F.transform(versions, lambda v: F.struct(version_key(v).alias("k"), v.alias("raw")))
    ordered = F.array_sort(F.filter(keyed, lambda e: e["k"].isNotNull()))
    return F.transform(ordered, lambda e: e["raw"])
