"""Closures, source facts, reachability verdicts and the whole scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import callgraph, matching, reachability, supply_chain
from plumbline.operators.graph import closure
from plumbline.operators.traces import fold_calls
from plumbline.plans import derived
from plumbline.plans.scan import SourceEvidence, ScanResult, advisory_facts, locate_dependencies, name_graph, scan
from plumbline.operators.enrichment import enrich
from plumbline.session import bucketed, materialize
from plumbline.sources.manifests import dependency_edges, mark_direct, merge_packages
from plumbline.sources.pyfacts import shared_facts, source_facts
from plumbline.workload import common as c
from plumbline.workload.matching import THREAT_SQL
from plumbline.workload.scoring import CVSS_SQL

VERDICT = ["project", "name", "version", "vuln_id"]
PACKAGE = ["project", "name"]


# Kinds of facts that the import level reads, and those that the inside of a dependency is read from.
USE_KINDS = ("file", "use", "attr")
INNER_KINDS = ("file", "def", "inner")
SIGNAL_KINDS = ("file", "unparsed", "call")


def _sources(spark, sf, *kinds: str):
    """The modules of all projects and their facts, of the ``kinds`` that the caller reads."""
    files = derived.run(spark, sf, derived.SOURCES, deal=("lineitem", "orders"))
    return files, source_facts(files, "project", "path", kinds=tuple(dict.fromkeys(kinds)))


def _dep_facts(spark, sf, *kinds: str):
    return shared_facts(derived.run(spark, sf, derived.DEP_SOURCES), "project", "root_ix", "path", kinds=tuple(dict.fromkeys(kinds)))


def _packages(spark, sf):
    """Resolved packages and edges of all projects."""
    rows = c.installs(spark, sf).withColumn("load_order", F.struct("l_linenumber", "l_suppkey", "l_partkey", "version"))
    values = ["project", "ecosystem", "name", "version", "direct", "confidence", "source", "load_order"]
    # Merging moves every row, and direct packages are found by reading the merged ones twice: they stay where merging put them.
    packages = bucketed(merge_packages(rows.select(*values)), PACKAGE, "merged").withColumn("purl", F.concat(F.lit("pkg:pypi/"), "name", F.lit("@"), "version"))
    edges = derived.run(spark, sf, derived.DEPENDS)
    declared = packages.select("project", "name").where("false")
    return mark_direct(packages, edges, declared), edges


def dependency_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges = derived.run(spark, sf, derived.HUB_EDGES)
    seeds = derived.run(spark, sf, derived.HUB_SEEDS)
    return closure(edges, seeds, ["project"])


DEPENDENCY_CLOSURE = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM ({derived.portable(derived.HUB_EDGES)})),
w(project, node, depth) USING KEY (project, node) AS (
  SELECT DISTINCT project, node, 0 FROM ({derived.portable(derived.HUB_SEEDS)})
  UNION
  SELECT w.project, e.dst, min(w.depth) + 1 FROM w JOIN e ON e.project = w.project AND e.src = w.node
  LEFT JOIN recurring.w seen ON seen.project = w.project AND seen.node = e.dst
  WHERE seen.node IS NULL GROUP BY w.project, e.dst)
SELECT project, node, depth FROM w
"""


def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    edges = derived.run(spark, sf, derived.HUB_EDGES)
    seeds = derived.run(spark, sf, derived.HUB_SEEDS)
    walked = closure(edges, seeds, ["project"], with_path=True)
    return walked.select("project", "node", "depth", c.text("path").alias("path"))


SHORTEST_PATHS = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM ({derived.portable(derived.HUB_EDGES)})),
w(project, node, depth, path) USING KEY (project, node) AS (
  SELECT DISTINCT project, node, 0, [node] FROM ({derived.portable(derived.HUB_SEEDS)})
  UNION
  SELECT w.project, e.dst, any_value(w.depth) + 1, min(list_append(w.path, e.dst))
  FROM w JOIN e ON e.project = w.project AND e.src = w.node
  LEFT JOIN recurring.w seen ON seen.project = w.project AND seen.node = e.dst
  WHERE seen.node IS NULL GROUP BY w.project, e.dst)
SELECT project, node, depth, array_to_string(path, '|') AS path FROM w
"""


def dependency_roots(spark: SparkSession, sf: str) -> DataFrame:
    packages, _ = _packages(spark, sf)
    return packages.where("direct").select("project", "name")


PACKAGES_CTE = f"""
p1 AS (SELECT * FROM ({c.INSTALLS_SQL})
       QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY l_linenumber, l_suppkey, l_partkey, version) = 1),
dep AS (SELECT * FROM ({derived.portable(derived.DEPENDS)})),
pk AS (SELECT p1.* EXCLUDE (direct), direct OR (bool_or(direct) OVER (PARTITION BY p1.project) = false
         AND NOT EXISTS (SELECT 1 FROM dep WHERE dep.project = p1.project AND dep.dst = p1.name)) AS direct FROM p1)
"""
DEPENDENCY_ROOTS = f"WITH {PACKAGES_CTE} SELECT project, name FROM pk WHERE direct"


def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Dependency lists become edges; names that no package has drop out."""
    i = c.installs(spark, sf)
    ghost = F.concat(F.lit("pkg-"), (F.col("l_suppkey") * 13).cast("string"))
    lists = i.select("project", "name", F.array(ghost, F.concat(F.lit("pkg-"), (F.col("l_partkey") % 50).cast("string")), F.col("name")).alias("depends_on"))
    return dependency_edges(lists).distinct()


DANGLING_EDGES = f"""
WITH i AS ({c.INSTALLS_SQL}),
e AS (SELECT project, name AS src, unnest(['pkg-' || CAST(l_suppkey * 13 AS VARCHAR), 'pkg-' || CAST(l_partkey % 50 AS VARCHAR), name]) AS dst FROM i)
SELECT DISTINCT e.* FROM e SEMI JOIN i ON i.project = e.project AND i.name = e.dst
"""


def import_uses(spark: SparkSession, sf: str) -> DataFrame:
    return reachability.import_uses(_sources(spark, sf, "use", "attr")[1])


# What the module texts say, line item by line item.
SOURCE_CTE = """
li AS (SELECT CAST(l_orderkey AS VARCHAR) AS project, l_orderkey, 'pkg-' || CAST(l_partkey AS VARCHAR) AS dist, l_partkey % 6 AS k, l_partkey,
         'm' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS m,
         'fn' || CAST(l_suppkey % 9 AS VARCHAR) AS fn, 'entry' || CAST(l_suppkey % 4 AS VARCHAR) AS entry FROM lineitem),
sh AS (SELECT CAST(o_orderkey AS VARCHAR) AS project, 'pkg-' || CAST(o_custkey AS VARCHAR) AS dist,
         'fn' || CAST(o_orderkey % 9 AS VARCHAR) AS fn FROM orders WHERE o_orderkey % 3 <> 0),
uses AS (
  SELECT project, dist, m || '.py' AS path, NULL AS symbol FROM li WHERE k IN (0, 1, 2, 3)
  UNION SELECT project, dist, m || '.py', fn FROM li WHERE k IN (0, 3)
  UNION SELECT project, dist, NULL, entry FROM li WHERE k IN (1, 2)
  UNION SELECT project, 'shared', m || '.py', NULL FROM li WHERE k = 2
  UNION SELECT project, 'shared', m || '.py', 'common' FROM li WHERE k = 2
  UNION SELECT project, 'importlib', m || '.py', NULL FROM li WHERE k = 5
  UNION SELECT project, 'importlib', NULL, 'import_module' FROM li WHERE k = 5
  UNION SELECT project, dist, 'shared.py', NULL FROM sh
  UNION SELECT project, dist, NULL, fn FROM sh),
analysed AS (SELECT project FROM li WHERE k <> 4 UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders),
paths AS (
  SELECT project, dist, fn AS symbol, 1 AS depth, [m || ':<toplevel>', m || '.run', dist || '.' || fn] AS path FROM li WHERE k = 0
  UNION ALL SELECT project, dist, entry, 1, [m || ':<toplevel>', m || '.work', dist || '.' || entry] FROM li WHERE k = 2
  UNION ALL SELECT li.project, sh.dist, sh.fn, 1, [m || ':<toplevel>', 'shared.common', sh.dist || '.' || sh.fn] FROM li JOIN sh ON sh.project = li.project WHERE k = 2
  UNION ALL SELECT project, 'shared', 'common', 0, [m || ':<toplevel>', 'shared.common'] FROM li WHERE k = 2 AND l_orderkey % 3 = 0
  UNION ALL SELECT project, dist, '<module>', 0, [m || ':<toplevel>', dist || '.<module>'] FROM li WHERE k = 5
  UNION ALL SELECT project, 'importlib', 'import_module', 0, [m || ':<toplevel>', 'importlib.import_module'] FROM li WHERE k = 5),
reached AS (SELECT project, dist, symbol, min({'d': depth, 'p': path}).p AS path FROM paths GROUP BY project, dist, symbol)
"""
IMPORT_USES = f"WITH {SOURCE_CTE} SELECT * FROM uses"


def call_paths(spark: SparkSession, sf: str) -> DataFrame:
    files, facts = _sources(spark, sf, *callgraph.CALL_KINDS)
    facts = materialize(facts, "facts")
    graph = callgraph.call_graph(facts, files)
    return callgraph.reached_symbols(*graph).select("project", "dist", "symbol", c.text("path").alias("path"))


CALL_PATHS = f"WITH {SOURCE_CTE} SELECT project, dist, symbol, array_to_string(path, '|') AS path FROM reached"


def direct_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Which projects call a distribution at all, in library mode."""
    files, facts = _sources(spark, sf, *callgraph.CALL_KINDS)
    graph = callgraph.call_graph(materialize(facts, "facts"), files)
    reached = callgraph.reached_symbols(*graph, library=True)
    return reached.groupBy("project", "dist").agg(F.count("*").alias("symbols"))


DIRECT_CALLERS = f"""
WITH {SOURCE_CTE}, everything AS (
  SELECT project, dist, symbol FROM reached
  UNION SELECT project, dist, fn FROM li WHERE k = 3
  UNION SELECT project, dist, fn FROM sh)
SELECT project, dist, count(*) AS symbols FROM everything GROUP BY project, dist
"""


def package_reachability(spark: SparkSession, sf: str) -> DataFrame:
    packages, edges = _packages(spark, sf)
    packages = materialize(packages, "packages")
    facts = materialize(_sources(spark, sf, *USE_KINDS)[1], "facts")
    uses = reachability.import_uses(facts)
    analysed = facts.where("kind = 'file'").select("project")
    return reachability.package_status(packages, edges, uses, analysed)


STATUS_CTE = """
roots AS (SELECT DISTINCT pk.project, pk.name FROM pk JOIN uses ON uses.project = pk.project AND uses.dist = pk.name),
walk(project, name) AS (SELECT * FROM roots UNION SELECT dep.project, dep.dst FROM walk JOIN dep ON dep.project = walk.project AND dep.src = walk.name),
status AS (SELECT pk.project, pk.name,
    CASE WHEN a.project IS NULL THEN 'unknown' WHEN w.name IS NOT NULL THEN 'reachable' ELSE 'unreachable' END AS status,
    a.project IS NOT NULL AND r.name IS NOT NULL AS imported
  FROM pk LEFT JOIN analysed a ON a.project = pk.project LEFT JOIN walk w ON w.project = pk.project AND w.name = pk.name
  LEFT JOIN roots r ON r.project = pk.project AND r.name = pk.name)
"""
PACKAGE_REACHABILITY = f"WITH RECURSIVE {PACKAGES_CTE}, {SOURCE_CTE}, {STATUS_CTE} SELECT * FROM status"


def _verdict_inputs(spark, sf):
    packages, edges = _packages(spark, sf)
    packages = materialize(packages, "packages")
    carried = packages.select("project", "ecosystem", "name", "version")
    index = materialize(matching.advisory_index(c.advisories(spark, sf)), "index")
    hits = matching.attach_hits(carried, matching.match_versions(carried, index))
    files, facts = _sources(spark, sf, *callgraph.CALL_KINDS, *USE_KINDS)
    facts = materialize(facts, "facts")
    uses = materialize(reachability.import_uses(facts), "uses")
    analysed = facts.where("kind = 'file'").select("project").distinct()
    status = reachability.package_status(packages, edges, uses, analysed)
    reached = materialize(callgraph.reached_symbols(*callgraph.call_graph(facts, files)), "reached")
    used = uses.where("symbol is not null").select("project", F.col("dist").alias("name"), "symbol").distinct()
    # The findings meet all evidence by their package, so that they are moved once.
    hits = bucketed(hits.join(status, PACKAGE), PACKAGE, "hits")
    return packages, reachability.refine_functions(hits, used, reached, analysed), reached


def _verdict_columns(found: DataFrame, *more: str) -> DataFrame:
    flags = ["symbol_hit", "affected_fn_not_reached", "analysis", *more]
    return found.select(*VERDICT, "status", *flags, c.text("call_path").alias("call_path"))


def function_refine(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_columns(_verdict_inputs(spark, sf)[1])


VERDICT_CTE = f"""
hit AS (SELECT pk.project, pk.name, pk.version, a.vuln_id, s.status, s.imported, {c.SYMBOLS} AS symbols, pk.l_partkey AS pkg,
          list_distinct(['fn' || CAST(o_orderkey % 9 AS VARCHAR), 'fn' || CAST(o_custkey % 9 AS VARCHAR)]) AS leaves,
          o_orderkey, {c.VKEY} AS vkey, i, f, q
        FROM pk JOIN ({c.ADVISORY_SQL}) a ON a.name = pk.name AND a.withdrawn IS NULL JOIN status s ON s.project = pk.project AND s.name = pk.name
        WHERE {c.IN_RANGE} OR coalesce(version = listed, false)),
sym AS (SELECT project, name, version, vuln_id, unnest(leaves) AS symbol FROM hit),
agg AS (SELECT s.project, s.name, s.version, s.vuln_id, bool_or(u.symbol IS NOT NULL) AS used,
          min(r.symbol) AS first_hit, arg_min(r.path, r.symbol) AS hit_path, list_sort(list(DISTINCT r.symbol) FILTER (r.symbol IS NOT NULL)) AS hit_symbols
        FROM sym s LEFT JOIN reached r ON r.project = s.project AND r.dist = s.name AND r.symbol = s.symbol
        LEFT JOIN (SELECT DISTINCT project, dist, symbol FROM uses WHERE symbol IS NOT NULL) u ON u.project = s.project AND u.dist = s.name AND u.symbol = s.symbol
        GROUP BY ALL),
called AS (SELECT DISTINCT project, dist FROM reached),
fn1 AS (SELECT h.*, a.used, a.hit_path, coalesce(a.hit_symbols, []) AS hit_symbols, n.project IS NOT NULL AS ok,
          h.status = 'reachable' AND n.project IS NOT NULL AND cl.dist IS NOT NULL AS by_call
        FROM hit h JOIN agg a ON a.project = h.project AND a.name = h.name AND a.version = h.version AND a.vuln_id = h.vuln_id
        LEFT JOIN analysed n ON n.project = h.project LEFT JOIN called cl ON cl.project = h.project AND cl.dist = h.name),
fn AS (SELECT *, CASE WHEN by_call THEN len(hit_symbols) > 0 ELSE used AND imported END AS symbol_hit,
         by_call AND len(hit_symbols) = 0 AS not_reached,
         CASE WHEN by_call AND len(hit_symbols) > 0 THEN hit_path ELSE [] END AS call_path,
         CASE WHEN by_call THEN hit_symbols ELSE [] END AS reached_symbols,
         CASE WHEN ok THEN 'function-level' ELSE 'package-level' END AS analysis FROM fn1)
"""
_ALL_CTE = f"WITH RECURSIVE {PACKAGES_CTE}, {SOURCE_CTE}, {STATUS_CTE}, {VERDICT_CTE}"
FUNCTION_REFINE = f"""{_ALL_CTE}
SELECT project, name, version, vuln_id, status, symbol_hit, not_reached AS affected_fn_not_reached, analysis,
  array_to_string(call_path, '|') AS call_path FROM fn
"""


def _deep(spark, sf):
    packages, found, reached = _verdict_inputs(spark, sf)
    found = bucketed(found, PACKAGE, "functions")
    deps = materialize(_dep_facts(spark, sf, *INNER_KINDS), "depfacts")
    located = materialize(locate_dependencies(packages, deps.where("kind = 'file'")), "located")
    edges, nodes = name_graph(deps, located)
    return reachability.refine_deep(found, reached, edges, nodes, located)


def deep_refine(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_columns(_deep(spark, sf), "deep", "proven_sink_unreachable")


DEEP_CTE = """
ent AS (SELECT project, dist AS name, min(symbol) AS entry, arg_min(path, symbol) AS entry_path FROM reached WHERE symbol LIKE 'entry%' GROUP BY 1, 2),
dp1 AS (SELECT fn.*, not_reached AND NOT symbol_hit AND (pkg // 6) % 3 < 2 AS looked, e.entry, e.entry_path,
          not_reached AND NOT symbol_hit AND (pkg // 6) % 3 = 0 AND e.entry IS NOT NULL AND list_contains(leaves, 'fn' || CAST(pkg % 9 AS VARCHAR)) AS deep
        FROM fn LEFT JOIN ent e ON e.project = fn.project AND e.name = fn.name),
dp AS (SELECT * EXCLUDE (symbol_hit, not_reached, call_path, analysis), symbol_hit OR deep AS symbol_hit, not_reached AND NOT looked AS not_reached,
         CASE WHEN deep THEN list_concat(entry_path, ['↘ ' || name || ' internals', name || '.inner', name || '.fn' || CAST(pkg % 9 AS VARCHAR)]) ELSE call_path END AS call_path,
         CASE WHEN looked THEN 'cross-package' ELSE analysis END AS analysis, looked AND NOT deep AS proven FROM dp1)
"""
DEEP_REFINE = f"""{_ALL_CTE}, {DEEP_CTE}
SELECT project, name, version, vuln_id, status, symbol_hit, not_reached AS affected_fn_not_reached, analysis, deep, proven AS proven_sink_unreachable,
  array_to_string(call_path, '|') AS call_path FROM dp
"""


def runtime_refine(spark: SparkSession, sf: str) -> DataFrame:
    traced = reachability.refine_runtime(bucketed(_deep(spark, sf), PACKAGE, "deep"), derived.run(spark, sf, derived.TRACE))
    return _verdict_columns(traced, "deep", "proven_sink_unreachable", "dynamic")


RUNTIME_CTE = f"""
tr AS (SELECT DISTINCT * FROM ({derived.portable(derived.TRACE)})),
rt1 AS (SELECT dp.*, t.project IS NOT NULL AS traced, tr.func IS NOT NULL AS dynamic FROM dp
  LEFT JOIN (SELECT DISTINCT project FROM tr) t ON t.project = dp.project
  LEFT JOIN tr ON tr.project = dp.project AND tr.module = 'mod' || CAST(o_orderkey % 5 AS VARCHAR) AND tr.func = 'fn' || CAST(o_orderkey % 9 AS VARCHAR)),
rt AS (SELECT * EXCLUDE (symbol_hit, not_reached, call_path, analysis), symbol_hit OR dynamic AS symbol_hit, not_reached AND NOT dynamic AS not_reached,
  CASE WHEN dynamic THEN ['RUNTIME CONFIRMED: mod' || CAST(o_orderkey % 5 AS VARCHAR) || '.fn' || CAST(o_orderkey % 9 AS VARCHAR)] ELSE call_path END AS call_path,
  CASE WHEN traced THEN 'dynamic-trace' ELSE analysis END AS analysis FROM rt1)
"""
RUNTIME_REFINE = f"""{_ALL_CTE}, {DEEP_CTE}, {RUNTIME_CTE}
SELECT project, name, version, vuln_id, status, symbol_hit, not_reached AS affected_fn_not_reached, analysis, deep, proven AS proven_sink_unreachable, dynamic,
  array_to_string(call_path, '|') AS call_path FROM rt
"""


def suspicious_calls(spark: SparkSession, sf: str) -> DataFrame:
    return supply_chain.suspicious_calls(_dep_facts(spark, sf, "call"), "project")


SUSPICIOUS_CALLS = f"""
WITH d AS (SELECT project, path, content FROM ({derived.portable(derived.DEP_SOURCES)}))
SELECT project, path, 'os.system call' AS label FROM d WHERE content LIKE '%os.system%'
UNION ALL SELECT project, path, 'usage of exec()' FROM d WHERE content LIKE '%exec(%'
UNION ALL SELECT project, path, 'base64 decoding (possible payload obfuscation)' FROM d WHERE content LIKE '%b64decode%'
UNION ALL SELECT project, path, 'subprocess execution (subprocess.run)' FROM d WHERE content LIKE '%subprocess.run%'
"""


def behaviour_signals(spark: SparkSession, sf: str) -> DataFrame:
    packages, _ = _packages(spark, sf)
    signals = supply_chain.behaviour_signals(packages.where("direct"), _dep_facts(spark, sf, *SIGNAL_KINDS))
    return signals.select("project", "name", "signal", "detail", "severity")


BEHAVIOUR_CTE = """
bh AS (SELECT project, name, 'malicious-behavior' AS signal, 'Suspicious AST patterns detected: ' || CASE l_partkey % 7
    WHEN 0 THEN 'base64 decoding (possible payload obfuscation) in __init__.py, os.system call in __init__.py, usage of exec() in __init__.py'
    ELSE 'subprocess execution (subprocess.run) in __init__.py' END AS detail, 0.95::DOUBLE AS severity
  FROM pk WHERE direct AND l_partkey % 7 < 2 AND (l_partkey // 6) % 3 < 2)
"""
BEHAVIOUR_SIGNALS = f"WITH {PACKAGES_CTE}, {BEHAVIOUR_CTE} SELECT * FROM bh"


def trace_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Call events folded to distinct functions per module."""
    events = derived.run(spark, sf, _CALL_EVENTS)
    return fold_calls(events).groupBy("module").agg(
        F.array_join(F.array_sort(F.collect_set("func")), "|").alias("funcs")
    )


_CALL_EVENTS = """
SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'mod' || CAST(user_id AS STRING) END AS module,
       CASE WHEN event_id % 20 = 0 THEN '<lambda>' WHEN event_id % 20 = 1 THEN '<module>' ELSE event_type END AS func,
       CASE WHEN event_id % 3 = 0 THEN 'return' ELSE 'call' END AS event, ts
FROM {events}
"""
TRACE_FOLD = f"""
SELECT module, string_agg(func, '|' ORDER BY func) AS funcs FROM (
  SELECT DISTINCT module, func FROM ({derived.portable(_CALL_EVENTS)})
  WHERE event = 'call' AND module <> '' AND (func NOT LIKE '<%' OR func = '<module>'))
GROUP BY module
"""


def popular(spark: SparkSession, sf: str) -> DataFrame:
    return derived.load(spark, sf, "supplier").select(F.concat(F.lit("pkg-"), F.col("s_suppkey").cast("string")).alias("popular"))


def run_scan(spark: SparkSession, sf: str) -> ScanResult:
    """The whole scan over all derived projects."""
    packages, edges = _packages(spark, sf)
    advisories = materialize(c.advisories(spark, sf), "advisories")
    enrichment = enrich(advisories, c.epss(spark, sf), c.kev(spark, sf))
    files, facts = _sources(spark, sf, *callgraph.CALL_KINDS, *USE_KINDS)
    evidence = SourceEvidence(files, facts, _dep_facts(spark, sf, *INNER_KINDS, *SIGNAL_KINDS), derived.run(spark, sf, derived.TRACE))
    return scan(
        packages, edges, matching.advisory_index(advisories),
        advisory_facts(advisories, enrichment), popular(spark, sf), evidence,
    )


def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = run_scan(spark, sf).findings
    return f.select(
        "project", "name", "version", "kind", "title", F.coalesce("vuln_id", "signal").alias("about"), "status", "analysis",
        "symbol_hit", "deep", "dynamic", "proven_sink_unreachable", "affected_fn_not_reached", "kev",
        F.round("epss", 6).alias("epss"), c.text("fixed_versions").alias("fixed_versions"), c.text("call_path").alias("call_path"),
        c.text("imported_symbols").alias("imported_symbols"), c.text("entry_paths").alias("entry_paths"),
        F.col("risk.value").alias("risk"), F.col("risk.band").alias("band"), F.col("risk.raw_value").alias("raw_risk"),
    )


_CVSS_BEST = "CASE o_orderkey % 10 WHEN 9 THEN NULL WHEN 8 THEN 0::DOUBLE WHEN 7 THEN (pkg % 10) + 0.5::DOUBLE ELSE cv.score END"
_EXPOSURE_SQL = "CASE status WHEN 'reachable' THEN 0.85::DOUBLE WHEN 'unknown' THEN 0.6 ELSE 0.3 END"
SCAN_CTE = f"""
{BEHAVIOUR_CTE},
threat AS ({THREAT_SQL}),
usum AS (SELECT project, dist, list_sort(list(DISTINCT symbol) FILTER (symbol IS NOT NULL)) AS syms,
           list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)) AS files FROM uses GROUP BY 1, 2),
v1 AS (SELECT rt.*, t.epss, t.kev, {_CVSS_BEST} AS cvss, us.syms, us.files
       FROM rt JOIN threat t ON t.vuln_id = rt.vuln_id LEFT JOIN ({CVSS_SQL}) cv ON cv.vuln_id = rt.vuln_id
       LEFT JOIN usum us ON us.project = rt.project AND us.dist = rt.name AND rt.imported),
conf AS (SELECT project, name, direct, confidence, CASE confidence WHEN 'lockfile' THEN 1::DOUBLE WHEN 'pinned' THEN 0.9 ELSE 0.55 END AS cw, version FROM pk),
v2 AS (SELECT v1.*, cw, CASE WHEN cvss IS NULL OR cvss = 0 THEN 0.5::DOUBLE ELSE cvss / 10 END
         * (0.7::DOUBLE + 0.3::DOUBLE * greatest(coalesce(epss, 0::DOUBLE), CASE WHEN kev THEN 0.9::DOUBLE ELSE 0::DOUBLE END)) AS hazard,
         CASE WHEN dynamic OR symbol_hit THEN 1::DOUBLE WHEN proven THEN least({_EXPOSURE_SQL}, 0.3::DOUBLE)
              WHEN not_reached THEN least({_EXPOSURE_SQL}, 0.6::DOUBLE) ELSE {_EXPOSURE_SQL} END AS exposure
       FROM v1 JOIN conf ON conf.project = v1.project AND conf.name = v1.name),
v3 AS (SELECT *, 100::DOUBLE * hazard * exposure AS raw, 100::DOUBLE * hazard * exposure * cw AS val FROM v2),
vf AS (SELECT project, name, version, 'vulnerability' AS kind, 'Issue in ' || name AS title, vuln_id AS about, status, analysis, symbol_hit, deep, dynamic,
         proven AS proven_sink_unreachable, not_reached AS affected_fn_not_reached, kev, round(epss, 6) AS epss,
         CASE WHEN {c.event_key('f', 'q')} > vkey THEN CAST(f AS VARCHAR) || '.' || CAST(q AS VARCHAR) ELSE '' END AS fixed_versions,
         array_to_string(call_path, '|') AS call_path,
         array_to_string(list_sort(list_distinct(list_concat(coalesce(syms, []), reached_symbols))), '|') AS imported_symbols,
         array_to_string(coalesce(files, []), '|') AS entry_paths, {c.sql_round('val', 1)} AS risk,
         CASE WHEN kev AND val < 35 THEN 'MEDIUM' ELSE {c.sql_band('val')} END AS band, {c.sql_round('raw', 1)} AS raw_risk FROM v3),
pop AS (SELECT 'pkg-' || CAST(s_suppkey AS VARCHAR) AS nearest FROM supplier),
near AS (SELECT x.name, nearest, levenshtein(x.name, nearest) AS d FROM (SELECT DISTINCT name FROM pk WHERE direct) x
         JOIN pop ON abs(length(x.name) - length(nearest)) <= 2 WHERE length(x.name) >= 4 AND x.name NOT IN (SELECT nearest FROM pop)),
best AS (SELECT name, min([CAST(d AS VARCHAR), nearest]) AS b FROM near WHERE d BETWEEN 1 AND 2 GROUP BY name),
sg AS (SELECT pk.project, pk.name, pk.version, 'typosquat' AS signal, ' ≈ ' || b[2] AS alike, CASE WHEN b[1] = '1' THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END AS sev
         FROM pk JOIN best ON best.name = pk.name WHERE pk.direct
       UNION ALL SELECT bh.project, bh.name, pk.version, signal, '', severity FROM bh JOIN pk ON pk.project = bh.project AND pk.name = bh.name),
s1 AS (SELECT sg.*, status, 100::DOUBLE * sev * greatest({_EXPOSURE_SQL}, 0.7::DOUBLE) AS raw, cw FROM sg JOIN status st ON st.project = sg.project AND st.name = sg.name
       JOIN conf ON conf.project = sg.project AND conf.name = sg.name),
sf AS (SELECT project, name, version, 'supply-chain' AS kind, 'Possible ' || signal || ': ' || name || alike AS title, signal AS about, status, 'package-level' AS analysis,
         false AS symbol_hit, false AS deep, false AS dynamic, false AS proven_sink_unreachable, false AS affected_fn_not_reached, false AS kev,
         NULL::DOUBLE AS epss, '' AS fixed_versions, '' AS call_path, '' AS imported_symbols, '' AS entry_paths,
         {c.sql_round('raw * cw', 1)} AS risk, {c.sql_band('(raw * cw)')} AS band, {c.sql_round('raw', 1)} AS raw_risk FROM s1),
allf AS (SELECT * FROM vf UNION ALL SELECT * FROM sf)
"""
SCAN_PREFIX = f"{_ALL_CTE}, {DEEP_CTE}, {RUNTIME_CTE}, {SCAN_CTE}"
SCAN_FINDINGS = f"{SCAN_PREFIX} SELECT * FROM allf"

QUERIES = {
    "dependency_closure": dependency_closure,
    "shortest_paths": shortest_paths,
    "dependency_roots": dependency_roots,
    "dangling_edges": dangling_edges,
    "import_uses": import_uses,
    "call_paths": call_paths,
    "direct_callers": direct_callers,
    "package_reachability": package_reachability,
    "function_refine": function_refine,
    "deep_refine": deep_refine,
    "runtime_refine": runtime_refine,
    "suspicious_calls": suspicious_calls,
    "behaviour_signals": behaviour_signals,
    "trace_fold": trace_fold,
    "scan_findings": scan_findings,
}
ORACLES = {
    "dependency_closure": DEPENDENCY_CLOSURE,
    "shortest_paths": SHORTEST_PATHS,
    "dependency_roots": DEPENDENCY_ROOTS,
    "dangling_edges": DANGLING_EDGES,
    "import_uses": IMPORT_USES,
    "call_paths": CALL_PATHS,
    "direct_callers": DIRECT_CALLERS,
    "package_reachability": PACKAGE_REACHABILITY,
    "function_refine": FUNCTION_REFINE,
    "deep_refine": DEEP_REFINE,
    "runtime_refine": RUNTIME_REFINE,
    "suspicious_calls": SUSPICIOUS_CALLS,
    "behaviour_signals": BEHAVIOUR_SIGNALS,
    "trace_fold": TRACE_FOLD,
    "scan_findings": SCAN_FINDINGS,
}
