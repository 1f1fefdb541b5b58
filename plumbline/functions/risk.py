"""The risk formula, its bands and its explanatory factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import exact_round

# Weights and thresholds of the published formula.
CONFIDENCE_WEIGHT = {"lockfile": 1.0, "pinned": 0.9, "constrained": 0.55, "imported": 0.3}
EXPOSURE = {"reachable": 0.85, "unknown": 0.6, "unreachable": 0.3}
BAND_FLOOR = {"CRITICAL": 80.0, "HIGH": 60.0, "MEDIUM": 35.0, "LOW": 15.0}
BANDS_ASCENDING = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
NEUTRAL_SEVERITY = 0.5
KEV_THREAT = 0.9
SUPPLY_CHAIN_EXPOSURE = 0.7


def _lookup(key: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, number in table.items():
        out = F.when(key == name, F.lit(number)).otherwise(out)
    return out


def confidence_weight(label: Column) -> Column:
    return _lookup(label, CONFIDENCE_WEIGHT)


def band(value: Column) -> Column:
    """Band of an unrounded value."""
    out = F.lit("INFO")
    for name, floor in reversed(BAND_FLOOR.items()):
        out = F.when(value >= floor, F.lit(name)).otherwise(out)
    return out


def band_ordinal(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(BANDS_ASCENDING):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out


def exposure(
    status: Column,
    dynamic: Column,
    symbol_hit: Column,
    proven_unreachable: Column,
    fn_not_reached: Column,
) -> Column:
    """Reachability weight: confirmed use counts fully, refuted use little."""
    base = _lookup(status, EXPOSURE)
    return (
        F.when(dynamic | symbol_hit, F.lit(1.0))
        .when(proven_unreachable, F.least(base, F.lit(0.3)))
        .when(fn_not_reached, F.least(base, F.lit(0.6)))
        .otherwise(base)
    )


def _flag(name: str, on: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.when(on, F.lit(1.0)).alias("value"))


def _factor(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.alias("value"))


def _factor_map(*entries: Column) -> Column:
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Add columns stage by stage. Each formula is then computed once and used as
    a column by the next stage, all inside generated code."""
    for columns in stages:
        df = df.withColumns(columns)
    return df


def with_vulnerability_risk(
    df: DataFrame,
    cvss: Column,
    epss: Column,
    kev: Column,
    confidence: Column,
    status: Column,
    dynamic: Column,
    symbol_hit: Column,
    deep: Column,
    proven_unreachable: Column,
    fn_not_reached: Column,
) -> DataFrame:
    """Add ``risk``: struct ``value, band, raw_value, factors``.

    A zero or missing CVSS score counts as neutral. A known-exploited match never
    falls below MEDIUM; the floor moves the band, not the value.
    """
    c = F.col
    no_hit = ~dynamic & ~symbol_hit
    scored = _staged(
        df,
        {
            "_severity": F.when(cvss.isNull() | (cvss == 0), F.lit(NEUTRAL_SEVERITY)).otherwise(cvss / 10.0),
            "_epss": F.coalesce(epss, F.lit(0.0)),
            "_exposure": exposure(status, dynamic, symbol_hit, proven_unreachable, fn_not_reached),
            "_conf": confidence_weight(confidence),
        },
        {"_threat": F.greatest(c("_epss"), F.when(kev, F.lit(KEV_THREAT)).otherwise(F.lit(0.0)))},
        {"_hazard": c("_severity") * (0.7 + 0.3 * c("_threat"))},
        {"_raw": F.lit(100.0) * c("_hazard") * c("_exposure")},
        {"_value": c("_raw") * c("_conf")},
        {"_band": band(c("_value"))},
        {"_lifted": kev & c("_band").isin("INFO", "LOW")},
    )
    factors = _factor_map(
        _factor("severity", exact_round(c("_severity"), 4)),
        _factor("threat", exact_round(c("_threat"), 4)),
        _factor("epss", exact_round(c("_epss"), 4)),
        _factor("kev", F.when(kev, F.lit(1.0)).otherwise(F.lit(0.0))),
        _factor("exposure", c("_exposure")),
        _factor("confidence", c("_conf")),
        _factor("hazard", exact_round(c("_hazard"), 4)),
        _flag("dynamic_trace_confirmed", dynamic),
        _flag("symbol_reached", dynamic | symbol_hit),
        _flag("cross_package_path", ~dynamic & symbol_hit & deep),
        _flag("proven_sink_unreachable", no_hit & proven_unreachable),
        _flag("affected_fn_not_reached", no_hit & ~proven_unreachable & fn_not_reached),
        _flag("kev_floor_applied", c("_lifted")),
    )
    risk = F.struct(
        exact_round(c("_value"), 1).alias("value"),
        F.when(c("_lifted"), F.lit("MEDIUM")).otherwise(c("_band")).alias("band"),
        exact_round(c("_raw"), 1).alias("raw_value"),
        factors.alias("factors"),
    )
    return scored.select(*df.columns, risk.alias("risk"))


def with_supply_chain_risk(df: DataFrame, severity: Column, confidence: Column, status: Column) -> DataFrame:
    """Add ``risk`` for a supply-chain signal.

    What a project declares it installs, so exposure has a floor.
    """
    c = F.col
    scored = _staged(
        df,
        {
            "_severity": severity,
            "_exposure": F.greatest(_lookup(status, EXPOSURE), F.lit(SUPPLY_CHAIN_EXPOSURE)),
            "_conf": confidence_weight(confidence),
        },
        {"_raw": F.lit(100.0) * c("_severity") * c("_exposure")},
        {"_value": c("_raw") * c("_conf")},
    )
    factors = _factor_map(
        _factor("severity", exact_round(c("_severity"), 4)),
        _factor("exposure", c("_exposure")),
        _factor("confidence", c("_conf")),
    )
    risk = F.struct(
        exact_round(c("_value"), 1).alias("value"),
        band(c("_value")).alias("band"),
        exact_round(c("_raw"), 1).alias("raw_value"),
        factors.alias("factors"),
    )
    return scored.select(*df.columns, risk.alias("risk"))
