"""Feeds, manifests, sources and traces as texts, read by the shipped readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import reachability, supply_chain
from plumbline.operators.traces import fold_calls, load_trace, trace_documents
from plumbline.plans import derived
from plumbline.plans.project import facts_or_errors, source_warnings
from plumbline.plans.scan import finding_counts
from plumbline.session import spread
from plumbline.sources import advisories, lockfiles
from plumbline.sources.pyfacts import source_facts

# Every supplier declares its dependencies in one of two ways, or in a broken file.
_PYPROJECT = """
    SELECT CAST(s_suppkey AS STRING) AS project, CASE s_suppkey % 3
      WHEN 0 THEN '[project]' || chr(10) || 'dependencies = ["Dep_' || CAST(s_suppkey AS STRING) || '>=1.0", "other.pkg[extra]; os_name == ' || chr(39) || 'nt' || chr(39) || '"]' || chr(10)
      WHEN 1 THEN '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.9"' || chr(10) || 'Poet_' || CAST(s_suppkey AS STRING) || ' = "*"' || chr(10)
      ELSE '[project' || chr(10) END AS content
    FROM {supplier}
"""


def declared_roots(spark: SparkSession, sf: str) -> DataFrame:
    return lockfiles.pyproject_roots(spread(derived.run(spark, sf, _PYPROJECT), "content"))


DECLARED_ROOTS = """
SELECT CAST(s_suppkey AS VARCHAR) AS project, 'dep-' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'other-pkg' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'poet-' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 1
"""

# A catalogue text for each customer: its own entry, one that its nation shares, one without an id.
_KEV_TEXTS = """
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'oops' ELSE
      '{{"vulnerabilities":[{{"cveID":"cve-2023-' || CAST(c_custkey AS STRING) || '","dateAdded":"2024-02-01"}},'
      || '{{"cveID":"CVE-1999-' || CAST(c_nationkey AS STRING) || '","dateAdded":"day ' || CAST(c_custkey AS STRING) || '"}},{{"cveID":"","dateAdded":"x"}}]}}' END AS content
    FROM {customer}
"""


def kev_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.parse_kev(derived.run(spark, sf, _KEV_TEXTS), "content", "c_custkey")


KEV_CATALOGUE = """
SELECT 'CVE-2023-' || CAST(c_custkey AS VARCHAR) AS cve, '2024-02-01' AS date_added FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'CVE-1999-' || CAST(c_nationkey AS VARCHAR), 'day ' || CAST(max(c_custkey) AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_nationkey
"""

# An OSV feed in two loads: arrays of two records, then single records that replace some, and texts that are no record.
_FEED = """
    SELECT 0 AS load, o_orderkey AS k, '[{{"id":"A-' || CAST(o_orderkey AS STRING) || '","summary":"first"}},{{"id":"B-' || CAST(o_custkey AS STRING) || '","summary":"' || CAST(o_orderkey AS STRING) || '"}}]' AS content
    FROM {orders}
    UNION ALL
    SELECT 1, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{{"id":"A-' || CAST(o_orderkey AS STRING) || '","summary":"second"}}' WHEN 1 THEN '[]' ELSE 'not json' END
    FROM {orders}
"""


def upserted_advisories(spark: SparkSession, sf: str) -> DataFrame:
    raw = spread(derived.run(spark, sf, _FEED), "content")
    parsed = advisories.parse_osv(raw.where(F.try_parse_json("content").isNotNull()), "content", "load", "k")
    return advisories.latest_records(parsed, "load", "k").select("id", "summary")


UPSERTED_ADVISORIES = """
SELECT 'A-' || CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first' END AS summary FROM orders
UNION ALL SELECT 'B-' || CAST(o_custkey AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR) FROM orders GROUP BY o_custkey
"""

# A module for each part that imports a name which differs from its distribution.
_IMPORTS = """
    SELECT CAST(p_partkey AS STRING) AS project, 'm.py' AS path, CASE p_partkey % 6
      WHEN 0 THEN 'import yaml' WHEN 1 THEN 'import cv2 as c' WHEN 2 THEN 'from PIL import Image' WHEN 3 THEN 'from sklearn.svm import SVC'
      WHEN 4 THEN 'import bs4.element' ELSE 'import local_' || CAST(p_partkey AS STRING) END || chr(10) AS content
    FROM {part}
"""


def mapped_imports(spark: SparkSession, sf: str) -> DataFrame:
    return reachability.import_uses(source_facts(spread(derived.run(spark, sf, _IMPORTS), "content"), "project", "path"))


MAPPED_IMPORTS = """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS project, p_partkey % 6 AS k FROM part),
dist AS (SELECT *, CASE k WHEN 0 THEN 'pyyaml' WHEN 1 THEN 'opencv-python' WHEN 2 THEN 'pillow' WHEN 3 THEN 'scikit-learn' WHEN 4 THEN 'beautifulsoup4' ELSE 'local-' || project END AS dist FROM p)
SELECT project, dist, 'm.py' AS path, NULL AS symbol FROM dist
UNION ALL SELECT project, dist, 'm.py', CASE k WHEN 2 THEN 'Image' ELSE 'SVC' END FROM dist WHERE k IN (2, 3)
"""

# Every line item calls one of fifteen functions from a dependency's source.
_CALLS = (
    "eval", "exec", "base64.b64decode", "base64.b32decode", "base64.b16decode", "urllib.urlopen", "requests.get", "requests.post",
    "socket.connect", "os.system", "subprocess.Popen", "subprocess.run", "subprocess.call", "subprocess.check_output", "os.path",
)
_CALL = "CASE l_partkey % 15 " + " ".join(f"WHEN {i} THEN '{call}'" for i, call in enumerate(_CALLS)) + " END"
_CALL_TEXTS = f"""
    SELECT DISTINCT CAST(l_orderkey AS STRING) AS project, 'node_modules/m' || CAST(l_partkey AS STRING) || '.py' AS path, {_CALL} || '(1)' || chr(10) AS content
    FROM {{lineitem}}
"""


def call_families(spark: SparkSession, sf: str) -> DataFrame:
    return supply_chain.suspicious_calls(source_facts(spread(derived.run(spark, sf, _CALL_TEXTS), "content"), "project", "path"), "project")


CALL_FAMILIES = f"""
WITH c AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS project, 'node_modules/m' || CAST(l_partkey AS VARCHAR) || '.py' AS path, {_CALL} AS call FROM lineitem)
SELECT project, path, CASE WHEN call IN ('eval', 'exec') THEN 'usage of ' || call || '()' WHEN call LIKE 'base64%' THEN 'base64 decoding (possible payload obfuscation)'
  WHEN call = 'os.system' THEN 'os.system call' WHEN call LIKE 'subprocess%' THEN 'subprocess execution (' || call || ')' ELSE 'network activity (' || call || ')' END AS label
FROM c WHERE call <> 'os.path'
"""

# Definitions further down for every other part.
_DEFINITIONS = """
    SELECT CAST(p_partkey AS STRING) AS project, 'm.py' AS path, repeat(chr(10), CAST(p_partkey % 5 AS INT)) || '@deco' || chr(10) || 'class A:' || chr(10)
      || '    def f(self):' || chr(10) || '        return 1' || chr(10) || chr(10) || '    async def g(self):' || chr(10) || '        pass' || chr(10) || chr(10)
      || 'def h():' || chr(10) || '    def inner():' || chr(10) || '        return 2' || chr(10) || '    return inner' || chr(10) AS content
    FROM {part}
"""


def definition_spans(spark: SparkSession, sf: str) -> DataFrame:
    facts = source_facts(spread(derived.run(spark, sf, _DEFINITIONS), "content"), "project", "path")
    return facts.where("kind in ('def', 'class')").select("project", "kind", "owner", "line", "end_line")


DEFINITION_SPANS = """
SELECT CAST(p_partkey AS VARCHAR) AS project, kind, owner, CAST(a + p_partkey % 5 AS INTEGER) AS line, CAST(b + p_partkey % 5 AS INTEGER) AS end_line
FROM part, (VALUES ('class', 'A', 1, 7), ('def', 'A.f', 3, 4), ('def', 'A.g', 6, 7), ('def', 'h', 9, 12), ('def', 'h.inner', 10, 11)) s(kind, owner, a, b)
"""


def unusable_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings about sources that are no valid Python or could not be read."""
    files = derived.run(spark, sf, derived.SOURCES, deal=("lineitem", "orders"))
    files = files.withColumn("error", F.when(F.col("path") == "other.py", F.lit("OSError: denied")))
    return source_warnings(facts_or_errors(files, "project", "path", kinds=("unparsed",)))


UNUSABLE_SOURCES = """
WITH broken AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS project, 'm' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) || '.py' AS path
                FROM lineitem WHERE l_partkey % 6 = 4)
SELECT project, CAST(count(*) AS VARCHAR) || ' source files could not be used (SyntaxError), first ' || min(path) AS message FROM broken GROUP BY project
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '1 source files could not be used (OSError: denied), first other.py' FROM orders WHERE o_orderkey % 3 = 0
"""


def project_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of every scanned project, also of those without a package."""
    orders = derived.load(spark, sf, "orders").withColumn("project", F.col("o_custkey").cast("string"))
    packages = orders.select("project", (F.col("o_orderkey") % 2 == 0).alias("direct"))
    kind = F.when(F.col("o_orderstatus") == "F", "supply-chain").otherwise("vulnerability")
    findings = orders.select("project", kind.alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, "reachable").otherwise("unknown").alias("status"))
    projects = derived.load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("project"))
    return finding_counts(packages, findings, projects)


PROJECT_COUNTS = """
SELECT CAST(c_custkey AS VARCHAR) AS project, count(o_orderkey) AS packages, count(*) FILTER (o_orderkey % 2 = 0) AS direct,
  count(*) FILTER (o_orderstatus <> 'F') AS vulnerabilities, count(*) FILTER (o_orderstatus = 'F') AS supply_chain, count(*) FILTER (o_orderkey % 3 = 0) AS reachable_findings
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
"""

# Call events of the stream, folded, written as trace texts and read again; one broken text more for each user.
_EVENTS = """
    SELECT CAST(user_id AS STRING) AS project, CASE WHEN event_type = 'error' THEN 'return' ELSE 'call' END AS event,
           'mod' || CAST(event_id % 5 AS STRING) AS module, CASE WHEN event_type = 'view' THEN '<lambda>' ELSE event_type END AS func
    FROM {events}
"""


def trace_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = trace_documents(fold_calls(derived.run(spark, sf, _EVENTS), "project"), "project")
    texts = rows.select("project", F.to_json(F.map_from_arrays(F.array("module"), F.array("functions"))).alias("content"))
    broken = rows.select("project", F.lit("no trace").alias("content")).distinct()
    return load_trace(texts.unionByName(broken), "project")


TRACE_TEXTS = """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS project, 'mod' || CAST(event_id % 5 AS VARCHAR) AS module, event_type AS func
FROM events WHERE event_type NOT IN ('error', 'view')
"""

QUERIES = {
    f.__name__: f
    for f in (
        declared_roots, kev_catalogue, upserted_advisories, mapped_imports, call_families, definition_spans, unusable_sources, project_counts, trace_texts,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
