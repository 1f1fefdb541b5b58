"""Queries in plain SQL over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import derived
from plumbline.sql import register

_VERSION = """CAST(p_partkey % 3 + 1 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING)
    || CASE p_partkey % 4 WHEN 0 THEN 'rc1' WHEN 1 THEN '.post2' ELSE '' END"""

_USES = f"""
    SELECT f.project, f.base AS module, count(DISTINCT f.p_partkey) AS files,
           count_if(version_between(f.version, '1.2', '2.0rc1', NULL)) AS hits,
           count_if(version_between(f.version, NULL, NULL, '2.3')) AS up_to, max_by(f.version, version_key(f.version)) AS newest
    FROM source_facts(TABLE(
        SELECT CAST(p_size AS STRING) AS project, p_partkey, {_VERSION} AS version,
               'import mod' || CAST(p_partkey % 5 AS STRING) || '\\n\\ndef f():\\n    return mod' || CAST(p_partkey % 5 AS STRING) || '.run()\\n' AS content
        FROM {{part}})) f
    WHERE f.kind = 'use' AND f.name IS NULL
    GROUP BY f.project, f.base
"""


def sql_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Per project and imported module: importing files, versions in two ranges and the newest version, in one SQL statement."""
    register(spark)
    return derived.run(spark, sf, _USES)


SQL_USES = f"""
SELECT project, module, count(*) AS files, count(*) FILTER (place >= 1020 AND place < 1999) AS hits, count(*) FILTER (place <= 2030) AS up_to, arg_max(version, place) AS newest
FROM (SELECT CAST(p_size AS VARCHAR) AS project, 'mod' || CAST(p_partkey % 5 AS VARCHAR) AS module, {derived.portable(_VERSION)} AS version,
        ((p_partkey % 3 + 1) * 100 + p_partkey % 7) * 10 + CASE p_partkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS place FROM part)
GROUP BY project, module
"""

QUERIES = {"sql_uses": sql_uses}
ORACLES = {"sql_uses": SQL_USES}
