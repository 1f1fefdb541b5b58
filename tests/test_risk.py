import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cvss, risk
from plumbline.functions.text import exact_round

COLUMNS = "cvss double, epss double, kev boolean, conf string, status string, dyn boolean, hit boolean, deep boolean, proven boolean, nr boolean"


def score(spark, *rows):
    df = spark.createDataFrame([r + (False,) * (10 - len(r)) for r in rows], COLUMNS)
    return [r.risk for r in risk.with_vulnerability_risk(df, *[F.col(c.split()[0]) for c in COLUMNS.split(", ")]).collect()]


def test_published_values(spark):
    got = score(
        spark,
        (9.8, 0.092, False, "lockfile", "reachable", False, True),
        (9.8, 0.061, False, "lockfile", "reachable", False, True),
        (7.5, 0.011, False, "lockfile", "reachable"),
        (9.8, 0.028, False, "lockfile", "reachable", False, False, False, False, True),
        (9.8, 0.028, False, "lockfile", "reachable", False, True, True),
        (9.8, 0.047, False, "lockfile", "unreachable"),
    )
    assert [(r.value, r.band) for r in got] == [(71.3, "HIGH"), (70.4, "HIGH"), (44.8, "MEDIUM"), (41.7, "MEDIUM"), (69.4, "HIGH"), (21.0, "LOW")]
    assert "cross_package_path" in got[4].factors and "affected_fn_not_reached" in got[3].factors


def test_monotone_and_floor(spark):
    base, kev, weak, none, zero = score(
        spark,
        (5.0, 0.1, False, "lockfile", "reachable"), (5.0, 0.1, True, "lockfile", "reachable"), (1.0, 0.0, True, "constrained", "unreachable"),
        (None, None, False, "lockfile", "reachable"), (0.0, None, False, "lockfile", "reachable"),
    )
    assert kev.value > base.value
    assert weak.band == "MEDIUM" and weak.value < 15 and weak.factors["kev_floor_applied"] == 1.0
    assert none.value == zero.value


def test_supply_chain(spark):
    df = spark.createDataFrame([(0.9, "lockfile", "unreachable")], "s double, c string, st string")
    r = risk.with_supply_chain_risk(df, F.col("s"), F.col("c"), F.col("st")).first().risk
    assert (r.value, r.band) == (63.0, "HIGH")


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_exact_round_is_python_round(spark, digits):
    rng = random.Random(1)
    xs = [rng.random() * 100 for _ in range(500)] + [k / (2 * 10**digits) for k in range(1, 999)] + [0.15, 44.85, 2.25, 0.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", exact_round(F.col("x"), digits).alias("r")).collect()
    assert [g for g in got if g.r != round(g.x, digits)] == []


@pytest.mark.parametrize("vector,want", [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
    ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0),
    ("cvss:3.1/av:n/ac:l/pr:l/ui:n/s:c/c:h/i:h/a:h", 9.9), ("CVSS:3.1/AV:N/AC:L", None), ("CVSS:3.1/AV:Q/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None),
])
def test_cvss(spark, vector, want):
    assert spark.range(1).select(cvss.base_score(F.lit(vector))).first()[0] == want


def test_best_severity_prefers_version_text(spark):
    sev = F.array(*[F.struct(F.lit(v).alias("version"), F.lit("x").alias("vector"), F.lit(s).alias("base_score")) for v, s in (("3.1", 9.8), ("4.0", 0.0))])
    row = spark.range(1).select(cvss.best_severity(sev).alias("a"), cvss.best_severity(sev, prefer_scored=True).alias("b")).first()
    assert (row.a.version, row.b.version) == ("4.0", "3.1")
