"""Inputs shared by the registered queries, and SQL snippets of their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import derived
from plumbline.sources.advisories import parse_epss, parse_osv


def installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.run(spark, sf_dir, derived.INSTALLS)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories parsed from the OSV documents of the orders.

    The documents are built from numbers, so a split of the table becomes much
    more text than it was bytes; the numbers are dealt before the texts are made.
    """
    return parse_osv(derived.run(spark, sf_dir, derived.OSV_TEXT, deal=("orders",)), "content", "o_orderkey")


def epss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_epss(derived.run(spark, sf_dir, derived.EPSS), "line")


def kev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.run(spark, sf_dir, derived.KEV)


def text(items) -> F.Column:
    """Arrays as text, so that results compare across engines."""
    return F.array_join(items, "|")


def sql_round(x: str, digits: int) -> str:
    """The exact binary half-even rounding, in SQL."""
    f = f"{2 * 10**digits}::DOUBLE"
    wide = f"(({x}) * 134217729::DOUBLE)"
    hi = f"({wide} - ({wide} - ({x})))"
    p = f"(({x}) * {f})"
    err = f"((({x}) - {hi}) * {f} - ({p} - {hi} * {f}))"
    mid = f"({p} = round_even({p}, 0) AND abs({p}) % 2 = 1)"
    return (
        f"((CASE WHEN {mid} AND {err} > 0 THEN ({p} + 1) / 2 WHEN {mid} AND {err} < 0 THEN ({p} - 1) / 2 "
        f"ELSE round_even({p} / 2, 0) END) / {10**digits}::DOUBLE)"
    )


def sql_band(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 80 THEN 'CRITICAL' WHEN {value} >= 60 THEN 'HIGH' WHEN {value} >= 35 THEN 'MEDIUM' "
        f"WHEN {value} >= 15 THEN 'LOW' ELSE 'INFO' END"
    )


INSTALLS_SQL = derived.portable(derived.INSTALLS)
ADVISORY_SQL = derived.portable(derived.ADVISORY_NUMBERS)
# Version order as a list of numbers, from the columns the text was built from.
VKEY = "[v_epoch, v_major, v_minor, v_pre, v_pre_n, v_post, v_dev, v_local]"


def event_key(major: str, minor: str) -> str:
    return f"[0, {major}, {minor}, 9, 0, -1, 99, -1]"


IN_RANGE = f"""(({VKEY} >= {event_key('i', '0')} AND {VKEY} < {event_key('f', 'q')})
    OR (i2 IS NOT NULL AND {VKEY} >= {event_key('i2', '0')} AND {VKEY} <= {event_key('i2', 'la')}))"""
SYMBOLS = """list_sort(list_distinct(['mod' || CAST(o_orderkey % 5 AS VARCHAR) || '.fn' || CAST(o_orderkey % 9 AS VARCHAR),
    'fn' || CAST(o_custkey % 9 AS VARCHAR)]))"""
