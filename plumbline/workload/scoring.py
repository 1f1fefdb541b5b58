"""CVSS, risk, look-alike names and finding summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cvss, risk
from plumbline.operators import supply_chain
from plumbline.operators.reachability import reach_label
from plumbline.plans import derived
from plumbline.plans.scan import band_histogram, finding_counts
from plumbline.workload import common as c


def cvss_base(spark: SparkSession, sf: str) -> DataFrame:
    v = derived.run(spark, sf, f"SELECT vuln_id, {derived.VECTOR} AS vector FROM ({derived.ADVISORY_NUMBERS}) n")
    return v.select(
        "vuln_id",
        cvss.base_score(F.col("vector")).alias("score"),
        cvss.base_score(F.regexp_replace("vector", "/UI:.", "")).isNull().alias("incomplete_is_null"),
    )


_CVSS_PARTS = f"""
SELECT vuln_id, sc,
  CASE av WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END AS w_av,
  CASE ac WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END AS w_ac,
  CASE WHEN pr = 'N' THEN 0.85::DOUBLE WHEN pr = 'L' AND sc = 'C' THEN 0.68 WHEN pr = 'L' THEN 0.62 WHEN sc = 'C' THEN 0.5 ELSE 0.27 END AS w_pr,
  CASE ui WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS w_ui,
  1::DOUBLE - (1 - CASE c WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END)
    * (1 - CASE ig WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END)
    * (1 - CASE av2 WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) AS iss
FROM ({c.ADVISORY_SQL})
"""
CVSS_SQL = f"""
SELECT vuln_id, CASE WHEN impact <= 0 THEN 0::DOUBLE
    WHEN round_even(total * 100000, 0) % 10000 = 0 THEN round_even(total * 100000, 0) / 100000
    ELSE (floor(round_even(total * 100000, 0) / 10000) + 1) / 10 END AS score, true AS incomplete_is_null
FROM (SELECT *, least(CASE WHEN sc = 'C' THEN 1.08::DOUBLE ELSE 1::DOUBLE END * (impact + ease), 10::DOUBLE) AS total
  FROM (SELECT *, 8.22::DOUBLE * w_av * w_ac * w_pr * w_ui AS ease,
          CASE WHEN sc = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15)
               ELSE 6.42::DOUBLE * iss END AS impact
        FROM ({_CVSS_PARTS})))
"""

# Risk inputs of a line item; every combination of verdict flags occurs.
_RISK_INPUTS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 9 = 1 THEN CAST(0 AS DOUBLE)
       ELSE CAST(l_suppkey % 100 AS DOUBLE) / 10 END AS cvss,
  CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_orderkey % 1000 AS DOUBLE) / 1000 END AS epss,
  l_suppkey % 6 = 0 AS kev, {derived.CONFIDENCE} AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'reachable' WHEN 1 THEN 'unknown' ELSE 'unreachable' END AS status,
  l_partkey % 8 = 0 AS dynamic, l_partkey % 4 < 2 AS symbol_hit, l_suppkey % 2 = 0 AS deep,
  l_partkey % 4 = 2 AS proven, l_partkey % 4 = 3 AS not_reached
FROM {{lineitem}}
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.run(spark, sf, _RISK_INPUTS)
    names = ("cvss", "epss", "kev", "confidence", "status", "dynamic", "symbol_hit", "deep", "proven", "not_reached")
    return risk.with_vulnerability_risk(r, *[F.col(n) for n in names])


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("risk.factors")
    flags = F.array_sort(F.filter(F.map_keys(f), lambda k: k.contains("_")))
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("risk.value").alias("value"), F.col("risk.raw_value").alias("raw_value"), F.col("risk.band").alias("band"),
        f["hazard"].alias("hazard"), f["exposure"].alias("exposure"), f["threat"].alias("threat"),
        c.text(flags).alias("flags"),
    )


_RISK_STEP1 = f"""
SELECT *, CASE WHEN cvss IS NULL OR cvss = 0 THEN 0.5::DOUBLE ELSE cvss / 10 END AS severity,
  greatest(coalesce(epss, 0::DOUBLE), CASE WHEN kev THEN 0.9::DOUBLE ELSE 0::DOUBLE END) AS threat,
  CASE WHEN dynamic OR symbol_hit THEN 1::DOUBLE
       WHEN proven THEN least(CASE status WHEN 'reachable' THEN 0.85::DOUBLE WHEN 'unknown' THEN 0.6 ELSE 0.3 END, 0.3::DOUBLE)
       WHEN not_reached THEN least(CASE status WHEN 'reachable' THEN 0.85::DOUBLE WHEN 'unknown' THEN 0.6 ELSE 0.3 END, 0.6::DOUBLE)
       ELSE CASE status WHEN 'reachable' THEN 0.85::DOUBLE WHEN 'unknown' THEN 0.6 ELSE 0.3 END END AS exposure,
  CASE confidence WHEN 'lockfile' THEN 1::DOUBLE WHEN 'pinned' THEN 0.9 ELSE 0.55 END AS conf
FROM ({derived.portable(_RISK_INPUTS)})
"""
_RISK_STEP2 = f"SELECT *, severity * (0.7::DOUBLE + 0.3::DOUBLE * threat) AS hazard FROM ({_RISK_STEP1})"
_RISK_STEP3 = f"SELECT *, 100::DOUBLE * hazard * exposure AS raw, 100::DOUBLE * hazard * exposure * conf AS val FROM ({_RISK_STEP2})"
_BAND_SQL = f"CASE WHEN kev AND val < 35 THEN 'MEDIUM' ELSE {c.sql_band('val')} END"
RISK_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {c.sql_round('val', 1)} AS value, {c.sql_round('raw', 1)} AS raw_value,
  {_BAND_SQL} AS band, {c.sql_round('hazard', 4)} AS hazard, {c.sql_round('exposure', 4)} AS exposure,
  {c.sql_round('threat', 4)} AS threat,
  array_to_string(list_sort(list_filter([
     CASE WHEN dynamic THEN 'dynamic_trace_confirmed' END,
     CASE WHEN dynamic OR symbol_hit THEN 'symbol_reached' END,
     CASE WHEN NOT dynamic AND symbol_hit AND deep THEN 'cross_package_path' END,
     CASE WHEN NOT dynamic AND NOT symbol_hit AND proven THEN 'proven_sink_unreachable' END,
     CASE WHEN NOT dynamic AND NOT symbol_hit AND NOT proven AND not_reached THEN 'affected_fn_not_reached' END,
     CASE WHEN kev AND val < 35 THEN 'kev_floor_applied' END], lambda x: x IS NOT NULL)), '|') AS flags
FROM ({_RISK_STEP3})
"""


def supply_chain_risk(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.run(spark, sf, _RISK_INPUTS)
    severity = F.when(F.col("l_partkey") % 3 == 0, 0.9).when(F.col("l_partkey") % 3 == 1, 0.55).otherwise(0.95)
    scored = risk.with_supply_chain_risk(r, severity, F.col("confidence"), F.col("status"))
    return scored.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "risk.value", "risk.band", "risk.raw_value"
    )


_SUPPLY = f"""
SELECT *, 100::DOUBLE * sev * greatest(CASE status WHEN 'reachable' THEN 0.85::DOUBLE WHEN 'unknown' THEN 0.6 ELSE 0.3 END, 0.7::DOUBLE) AS raw
FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.55 ELSE 0.95 END AS sev,
        CASE confidence WHEN 'lockfile' THEN 1::DOUBLE WHEN 'pinned' THEN 0.9 ELSE 0.55 END AS conf
      FROM ({derived.portable(_RISK_INPUTS)}))
"""
SUPPLY_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {c.sql_round('raw * conf', 1)} AS value,
  {c.sql_band('(raw * conf)')} AS band, {c.sql_round('raw', 1)} AS raw_value
FROM ({_SUPPLY})
"""

_KIND = "CASE WHEN l_suppkey % 5 = 0 THEN 'supply-chain' ELSE 'vulnerability' END"


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).withColumn("kind", F.expr(_KIND)).withColumn("project", F.col("l_suppkey"))


def finding_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    found = _findings(spark, sf)
    packages = derived.run(spark, sf, "SELECT l_suppkey AS project, l_linenumber = 1 AS direct FROM {lineitem}")
    return finding_counts(packages, found)


FINDING_COUNTS = f"""
SELECT l_suppkey AS project, count(*) AS packages, count(*) FILTER (l_linenumber = 1) AS direct,
  count(*) FILTER (({_KIND}) = 'vulnerability') AS vulnerabilities, count(*) FILTER (({_KIND}) = 'supply-chain') AS supply_chain,
  count(*) FILTER (l_linenumber % 3 = 0) AS reachable_findings
FROM lineitem GROUP BY l_suppkey
"""


def band_histogram_query(spark: SparkSession, sf: str) -> DataFrame:
    return band_histogram(_findings(spark, sf))


BAND_HISTOGRAM = f"""
WITH f AS (SELECT l_suppkey AS project, {_BAND_SQL} AS band FROM ({_RISK_STEP3}))
SELECT p.project, b.band, count(f.band) AS findings
FROM (SELECT DISTINCT project FROM f) p CROSS JOIN (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) b(band)
LEFT JOIN f ON f.project = p.project AND f.band = b.band GROUP BY p.project, b.band
"""


def risk_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Per project: findings at or above a score, and the CI gate at HIGH."""
    found = _findings(spark, sf)
    kept = found.where(F.col("risk.value") >= 40)
    high = risk.band_ordinal(F.col("risk.band")) >= risk.BANDS_ASCENDING.index("HIGH")
    return kept.groupBy("project").agg(
        F.count("*").alias("kept"), F.max(F.when(high, 1).otherwise(0)).alias("exit_code"),
        F.count_if(F.col("kind") == "vulnerability").alias("vulnerabilities"),
    )


RISK_GATE = f"""
SELECT l_suppkey AS project, count(*) AS kept, max(CASE WHEN {_BAND_SQL} IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END) AS exit_code,
  count(*) FILTER (({_KIND}) = 'vulnerability') AS vulnerabilities
FROM ({_RISK_STEP3}) WHERE {c.sql_round('val', 1)} >= 40 GROUP BY l_suppkey
"""


def reach_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.run(spark, sf, _RISK_INPUTS)
    label = reach_label(*[F.col(n) for n in ("status", "dynamic", "symbol_hit", "deep", "proven", "not_reached")])
    return r.groupBy(F.col("l_suppkey").alias("project"), label.alias("label")).agg(F.count("*").alias("n"))


REACH_LABELS = f"""
SELECT l_suppkey AS project, CASE WHEN status = 'unreachable' THEN 'unreachable' WHEN status = 'unknown' THEN 'unknown'
  WHEN dynamic THEN 'REACH:DYN' WHEN symbol_hit THEN CASE WHEN deep THEN 'REACH:DEEP' ELSE 'REACH:SYM' END
  WHEN proven THEN 'proven-safe' WHEN not_reached THEN 'reach:indirect' ELSE 'REACHABLE' END AS label, count(*) AS n
FROM ({derived.portable(_RISK_INPUTS)}) GROUP BY 1, 2
"""

# Perturbed part names: one character dropped, doubled or swapped in, or two.
_NAMES = """
SELECT pkg, pop, CASE pkg % 6
    WHEN 0 THEN pop
    WHEN 1 THEN substr(pop, 1, pos - 1) || substr(pop, pos + 1)
    WHEN 2 THEN substr(pop, 1, pos) || substr(pop, pos)
    WHEN 3 THEN substr(pop, 1, pos - 1) || 'x' || substr(pop, pos + 1)
    WHEN 4 THEN 'y' || substr(pop, 1, pos - 1) || 'z' || substr(pop, pos)
    ELSE substr(pop, 3) || 'qq' END AS name
FROM (SELECT p_partkey AS pkg, replace(p_name, ' ', '-') AS pop,
             CAST(p_partkey % length(p_name) AS INT) + 1 AS pos FROM {part}) p
"""


def typosquat(spark: SparkSession, sf: str) -> DataFrame:
    names = derived.run(spark, sf, _NAMES)
    popular = names.select(F.col("pop").alias("popular")).distinct()
    direct = names.select("pkg", "name")
    return supply_chain.typosquat_signals(direct, popular).select("pkg", "name", "nearest", "distance", "severity", "detail")


TYPOSQUAT = f"""
WITH n AS ({derived.portable(_NAMES)}), pop AS (SELECT DISTINCT pop AS nearest FROM n),
near AS (SELECT name, nearest, levenshtein(name, nearest) AS d
         FROM (SELECT DISTINCT name FROM n) x JOIN pop ON abs(length(name) - length(nearest)) <= 2
         WHERE length(name) >= 4 AND name NOT IN (SELECT nearest FROM pop)),
best AS (SELECT name, min([CAST(d AS VARCHAR), nearest]) AS b FROM near WHERE d BETWEEN 1 AND 2 GROUP BY name)
SELECT pkg, n.name, b[2] AS nearest, CAST(b[1] AS INT) AS distance,
  CASE WHEN b[1] = '1' THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END AS severity,
  'declared dependency ''' || n.name || ''' is edit-distance ' || b[1] || ' from popular package ''' || b[2] || '''' AS detail
FROM n JOIN best ON best.name = n.name
"""

QUERIES = {
    "cvss_base": cvss_base,
    "risk_score": risk_score,
    "supply_chain_risk": supply_chain_risk,
    "finding_counts": finding_counts_query,
    "band_histogram": band_histogram_query,
    "risk_gate": risk_gate,
    "reach_labels": reach_labels,
    "typosquat": typosquat,
}
ORACLES = {
    "cvss_base": CVSS_SQL,
    "risk_score": RISK_SQL,
    "supply_chain_risk": SUPPLY_SQL,
    "finding_counts": FINDING_COUNTS,
    "band_histogram": BAND_HISTOGRAM,
    "risk_gate": RISK_GATE,
    "reach_labels": REACH_LABELS,
    "typosquat": TYPOSQUAT,
}
