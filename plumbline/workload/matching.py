"""Identity, version order, advisory matching and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import identity, versions
from plumbline.functions.cvss import best_severity
from plumbline.functions.identity import first_cve
from plumbline.operators import matching
from plumbline.operators.enrichment import enrich
from plumbline.operators.mining import replace_mined
from plumbline.plans import derived
from plumbline.plans.digest import parallel_digest
from plumbline.session import materialize
from plumbline.sources.manifests import manifest_rank, merge_packages, most_trusted
from plumbline.workload import common as c


def package_identity(spark: SparkSession, sf: str) -> DataFrame:
    p = derived.run(spark, sf, derived.PACKAGES)
    eco, raw, version = F.col("ecosystem"), F.col("raw_name"), F.col("version")
    return p.select(
        "pkg",
        identity.pypi_name(raw).alias("canonical"),
        identity.feed_name(eco, raw).alias("feed_name"),
        identity.coordinate(eco, raw).alias("coordinate"),
        identity.purl(eco, raw, version).alias("purl"),
        version.isNotNull().alias("matchable"),
    )


_NORM = "lower(trim(regexp_replace(raw_name, '[-_.]+', '-', 'g'), '-'))"
_PURL_NAME = f"CASE ecosystem WHEN 'PyPI' THEN {_NORM} WHEN 'npm' THEN lower(raw_name) WHEN 'Go' THEN lower(raw_name) ELSE raw_name END"
PACKAGE_IDENTITY = f"""
SELECT pkg, {_NORM} AS canonical,
       CASE WHEN ecosystem = 'PyPI' THEN {_NORM} ELSE lower(raw_name) END AS feed_name,
       'pkg:' || lower(ecosystem) || '/' || {_PURL_NAME} AS coordinate,
       'pkg:' || lower(ecosystem) || '/' || {_PURL_NAME} || coalesce('@' || version, '') AS purl,
       version IS NOT NULL AS matchable
FROM ({derived.portable(derived.PACKAGES)})
"""


def version_order(spark: SparkSession, sf: str) -> DataFrame:
    i = c.installs(spark, sf)
    other = F.concat((F.col("l_suppkey") % 8).cast("string"), F.lit("."), (F.col("l_partkey") % 50).cast("string"), F.lit(".0"))
    facts = versions.version_facts(F.col("version"))
    return i.select(
        "project", "l_linenumber", "l_partkey", "l_suppkey",
        versions.compare_versions(F.col("version"), other).alias("cmp"),
        facts["is_prerelease"].alias("is_prerelease"),
        facts["is_postrelease"].alias("is_postrelease"),
        facts["base_version"].alias("base_version"),
        versions.version_key(F.concat(F.lit("~"), "version")).isNull().alias("invalid_is_null"),
    )


_OTHER = c.event_key("l_suppkey % 8", "l_partkey % 50")
VERSION_ORDER = f"""
SELECT project, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN {c.VKEY} < {_OTHER} THEN -1 WHEN {c.VKEY} = {_OTHER} THEN 0 ELSE 1 END AS cmp,
       v_pre IN (1, 2) OR v_dev < 99 AS is_prerelease,
       v_post >= 0 AS is_postrelease,
       CASE WHEN v_epoch = 1 THEN '1!' ELSE '' END || CAST(v_major AS VARCHAR) || '.' || CAST(v_minor AS VARCHAR)
         || CASE WHEN l_partkey % 4 = 0 THEN '.0' ELSE '' END AS base_version,
       true AS invalid_is_null
FROM ({c.INSTALLS_SQL})
"""


def version_extremes(spark: SparkSession, sf: str) -> DataFrame:
    # Written, because min and max above do not mind copies and the optimizer would drop the distinct: a version is parsed once.
    coords = materialize(c.installs(spark, sf).select("name", "version").distinct(), "coords")
    keyed = coords.withColumn("k", versions.version_key(F.col("version")))
    # Equal versions in different spellings fall together first.
    distinct = keyed.groupBy("name", "k").agg(F.min("version").alias("first"), F.max("version").alias("last"))
    return distinct.groupBy("name").agg(
        F.min_by("first", "k").alias("oldest"), F.max_by("last", "k").alias("newest"), F.count("*").alias("n_versions")
    )


VERSION_EXTREMES = f"""
SELECT name, arg_min(version, {c.VKEY}) AS oldest, arg_max(version, {c.VKEY}) AS newest,
       count(DISTINCT {c.VKEY}) AS n_versions
FROM ({c.INSTALLS_SQL}) GROUP BY name
"""


def _without(index: DataFrame, field: str) -> DataFrame:
    empty = {"versions": "array<string>", "ranges": "array<array<struct<k:string,at:boolean,after:boolean>>>"}[field]
    return index.withColumn("entries", F.transform("entries", lambda e: e.withField(field, F.array().cast(empty))))


def _hits(spark: SparkSession, sf: str, drop: str | None = None) -> DataFrame:
    i = c.installs(spark, sf)
    index = matching.advisory_index(c.advisories(spark, sf))
    if drop:
        index = _without(index, drop)
    # Written, the index has a known size when the join is planned.
    index = materialize(index, "index")
    return matching.attach_hits(i, matching.match_versions(i, index))


def range_match(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "versions").select("project", "l_linenumber", "l_suppkey", "name", "version", "vuln_id")


_JOINED = f"""({c.INSTALLS_SQL}) l JOIN ({c.ADVISORY_SQL}) a ON a.name = l.name AND a.withdrawn IS NULL"""
RANGE_MATCH = f"""
SELECT project, l_linenumber, l_suppkey, l.name, version, vuln_id FROM {_JOINED} WHERE {c.IN_RANGE}
"""


def version_list_match(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "ranges").select("project", "l_linenumber", "l_suppkey", "name", "version", "vuln_id")


VERSION_LIST_MATCH = f"""
SELECT project, l_linenumber, l_suppkey, l.name, version, vuln_id FROM {_JOINED} WHERE version = listed
"""


def advisory_match(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select(
        "project", "l_linenumber", "l_suppkey", "name", "version", "vuln_id",
        c.text("fixed_versions").alias("fixed_versions"), c.text("symbols").alias("symbols"),
    )


_FIXED = f"CASE WHEN {c.event_key('f', 'q')} > {c.VKEY} THEN CAST(f AS VARCHAR) || '.' || CAST(q AS VARCHAR) ELSE '' END"
ADVISORY_MATCH = f"""
SELECT project, l_linenumber, l_suppkey, l.name, version, vuln_id, {_FIXED} AS fixed_versions,
       array_to_string({c.SYMBOLS}, '|') AS symbols
FROM {_JOINED} WHERE {c.IN_RANGE} OR coalesce(version = listed, false)
"""


def fixed_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Per package and installed version: all newer fixes of its advisories."""
    i = c.installs(spark, sf)
    index = materialize(matching.advisory_index(c.advisories(spark, sf)), "index")
    # The fixes come with the keys they were compared by; none is parsed again for a hit.
    hits = matching.match_versions(i, index, keyed_fixes=True)
    fixes = hits.select("name", "version", F.explode("fixes").alias("f"))
    keyed = fixes.select("name", "version", F.col("f.version").alias("fix"), "f.k").distinct()
    return keyed.groupBy("name", "version").agg(
        F.count("*").alias("n_fixes"),
        F.min_by("fix", F.struct("k", "fix")).alias("first_fix"),
        F.max_by("fix", F.struct("k", "fix")).alias("last_fix"),
    )


FIXED_VERSIONS = f"""
WITH hit AS (
  SELECT DISTINCT l.name, version, f, q FROM {_JOINED}
  WHERE ({c.IN_RANGE} OR coalesce(version = listed, false)) AND {c.event_key('f', 'q')} > {c.VKEY})
SELECT name, version, count(*) AS n_fixes,
       arg_min(CAST(f AS VARCHAR) || '.' || CAST(q AS VARCHAR), [f, q]) AS first_fix,
       arg_max(CAST(f AS VARCHAR) || '.' || CAST(q AS VARCHAR), [f, q]) AS last_fix
FROM hit GROUP BY name, version
"""


def osv_records(spark: SparkSession, sf: str) -> DataFrame:
    a = c.advisories(spark, sf)
    best = best_severity(F.col("severity"))
    entry = F.col("affected")[0]
    events = F.flatten(F.transform(entry["ranges"], lambda r: r["events"]))
    return a.select(
        "id", "summary", "modified", "withdrawn",
        entry["ecosystem"].alias("ecosystem"),
        entry["name"].alias("name"),
        F.size("aliases").alias("n_aliases"),
        first_cve(F.col("id"), F.col("aliases")).alias("cve"),
        best["version"].alias("cvss_version"),
        (best["base_score"] > 0).alias("scored"),
        F.size(events).alias("n_events"),
        c.text(entry["versions"]).alias("listed"),
        c.text(entry["symbols"]).alias("symbols"),
        c.text("fix_commits").alias("fix_commits"),
    )


OSV_RECORDS = f"""
SELECT vuln_id AS id, 'Issue in ' || name AS summary, CAST(modified AS VARCHAR) AS modified, withdrawn, 'PyPI' AS ecosystem, name,
       CAST((cve1 IS NOT NULL)::INT + (cve2 IS NOT NULL)::INT AS INT) AS n_aliases,
       upper(coalesce(cve1, cve2)) AS cve,
       CASE o_orderkey % 10 WHEN 9 THEN NULL WHEN 8 THEN '4.0' WHEN 7 THEN '3.0' ELSE '3.1' END AS cvss_version,
       CASE o_orderkey % 10 WHEN 9 THEN NULL WHEN 8 THEN false WHEN 7 THEN true
            ELSE NOT (c = 'N' AND ig = 'N' AND av2 = 'N') END AS scored,
       CASE WHEN i2 IS NULL THEN 2 ELSE 4 END AS n_events,
       coalesce(listed, '') AS listed,
       'mod' || CAST(o_orderkey % 5 AS VARCHAR) || '.fn' || CAST(o_orderkey % 9 AS VARCHAR) || '|fn' || CAST(o_custkey % 9 AS VARCHAR) AS symbols,
       'https://example.org/commit/' || CAST(o_orderkey AS VARCHAR) AS fix_commits
FROM ({c.ADVISORY_SQL})
"""


def epss_rows(spark: SparkSession, sf: str) -> DataFrame:
    return c.epss(spark, sf)


_EPSS_SQL = f"""
SELECT upper(cve) AS cve, arg_max(s, line) AS score, arg_max(p, line) AS percentile FROM (
  SELECT cve, line, TRY_CAST(coalesce(nullif(epss, ''), '0') AS DOUBLE) AS s,
         TRY_CAST(coalesce(nullif(percentile, ''), '0') AS DOUBLE) AS p
  FROM ({derived.portable(derived.EPSS)}))
WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY upper(cve)
"""


def threat_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(c.advisories(spark, sf), c.epss(spark, sf), c.kev(spark, sf))


THREAT_SQL = f"""
SELECT vuln_id, coalesce(e2.score, e1.score) AS epss, coalesce(e2.percentile, e1.percentile) AS epss_percentile,
       k2.cve IS NOT NULL AS kev, k2.date_added AS kev_date_added,
       CASE WHEN e1.cve IS NULL AND e2.cve IS NULL THEN 'none' ELSE 'seed' END AS enrichment_source
FROM ({c.ADVISORY_SQL}) a
LEFT JOIN ({_EPSS_SQL}) e1 ON e1.cve = upper(a.cve1)
LEFT JOIN ({_EPSS_SQL}) e2 ON e2.cve = upper(a.cve2)
LEFT JOIN ({derived.portable(derived.KEV)}) k2 ON k2.cve = upper(a.cve2)
"""


def package_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Many manifest rows per package: the first with a version counts."""
    rows = derived.run(spark, sf, f"SELECT * FROM ({derived.INSTALLS})")
    unsure = F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("version"))
    dup = rows.select(
        F.col("l_suppkey").cast("string").alias("project"), "name",
        unsure.alias("version"), "confidence",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("load_order"),
    )
    return merge_packages(dup)


PACKAGE_DEDUPE = f"""
SELECT CAST(l_suppkey AS VARCHAR) AS project, name,
       arg_min(CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE version END, o) AS version0,
       arg_min(confidence, o) AS confidence
FROM (SELECT *, [CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END, l_orderkey, l_linenumber, l_suppkey] AS o FROM ({c.INSTALLS_SQL}))
GROUP BY 1, 2
"""
PACKAGE_DEDUPE = f"SELECT project, name, nullif(version0, '') AS version, confidence FROM ({PACKAGE_DEDUPE})"


def manifest_authority(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests per project by kind; only the most trusted ones stay."""
    m = derived.run(spark, sf, _MANIFESTS)
    ranked = m.withColumn("rank", manifest_rank(F.col("kind"))).where("rank is not null")
    return most_trusted(ranked).select("project", "path", "kind", "rank")


_MANIFESTS = """
SELECT CAST(o_custkey AS STRING) AS project, 'p' || CAST(o_orderkey AS STRING) AS path,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'pdm.lock' WHEN '2-HIGH' THEN 'uv.lock' WHEN '3-MEDIUM' THEN 'Pipfile.lock'
            WHEN '5-LOW' THEN 'requirements.txt' ELSE 'setup.cfg' END AS kind
FROM {orders}
"""
MANIFEST_AUTHORITY = f"""
WITH r AS (SELECT *, CASE kind WHEN 'pdm.lock' THEN 40 WHEN 'uv.lock' THEN 40 WHEN 'Pipfile.lock' THEN 35
                       WHEN 'requirements.txt' THEN 20 END AS rank FROM ({derived.portable(_MANIFESTS)}))
SELECT project, path, kind, rank FROM r WHERE rank = (SELECT max(rank) FROM r r2 WHERE r2.project = r.project)
"""


def mined_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Mined symbols folded into the matching index (per advisory and package)."""
    index = matching.advisory_index(c.advisories(spark, sf))
    mined = derived.run(spark, sf, _MINED)
    stored = mined.where("source = 'old'")
    fresh = mined.where("source = 'new'").withColumn("source", F.lit("old"))
    merged = matching.merge_mined_symbols(index, replace_mined(stored, fresh))
    return merged.select("vuln_id", "name", F.explode("entries").alias("e")).select(
        "vuln_id", "name", c.text(F.col("e.symbols")).alias("symbols")
    )


_MINED = """
SELECT 'SYN-' || CAST(l_orderkey AS STRING) AS vuln_id, 'pypi' AS ecosystem, 'pkg-' || CAST(o_custkey AS STRING) AS name,
       'fn' || CAST(l_partkey % 9 AS STRING) AS symbol, 'C.fn' || CAST(l_partkey % 9 AS STRING) AS qualified,
       CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'old' END AS source
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
MINED_MERGE = f"""
WITH m AS ({derived.portable(_MINED)}),
k AS (SELECT DISTINCT vuln_id, symbol FROM m WHERE source = 'new'
      OR vuln_id NOT IN (SELECT vuln_id FROM m WHERE source = 'new')),
g AS (SELECT vuln_id, list(symbol) AS s FROM k GROUP BY vuln_id)
SELECT a.vuln_id, name,
  array_to_string(list_concat(base, list_sort(list_filter(coalesce(s, []), lambda x: NOT list_contains(base, x)))), '|') AS symbols
FROM (SELECT *, ['mod' || CAST(o_orderkey % 5 AS VARCHAR) || '.fn' || CAST(o_orderkey % 9 AS VARCHAR),
        'fn' || CAST(o_custkey % 9 AS VARCHAR)] AS base FROM ({c.ADVISORY_SQL})) a
LEFT JOIN g ON g.vuln_id = a.vuln_id WHERE withdrawn IS NULL
"""


def mined_advisories(spark: SparkSession, sf: str) -> DataFrame:
    return derived.run(spark, sf, _MINED).agg(F.count_distinct("vuln_id").alias("mined_advisories"))


MINED_ADVISORIES = f"SELECT count(DISTINCT vuln_id) AS mined_advisories FROM ({derived.portable(_MINED)})"


def record_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every whole text, as inputs are recorded in a manifest."""
    d = derived.load(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = derived.load(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p).select("kind", "id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"))


RECORD_DIGESTS = """
SELECT 'documents' AS kind, doc_id AS id, 'sha256:' || sha256(text) AS sha256 FROM documents
UNION ALL SELECT 'pages', page_id, 'sha256:' || sha256(html) FROM pages
"""


def snapshot_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Content digest of the whole advisory set as one parallel aggregate."""
    return parallel_digest(c.advisories(spark, sf), "id", "modified")


_WORDS = " || ':' || ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)
)
SNAPSHOT_DIGEST = f"""
SELECT count(*) AS records, sha256(CAST(count(*) AS VARCHAR) || ':' || {_WORDS}) AS digest
FROM (SELECT sha256('{{"id":"' || vuln_id || '","modified":"' || CAST(modified AS VARCHAR) || '"}}') AS h FROM ({c.ADVISORY_SQL}))
"""

QUERIES = {
    "package_identity": package_identity,
    "version_order": version_order,
    "version_extremes": version_extremes,
    "range_match": range_match,
    "version_list_match": version_list_match,
    "advisory_match": advisory_match,
    "fixed_versions": fixed_versions,
    "osv_records": osv_records,
    "epss_rows": epss_rows,
    "threat_enrichment": threat_enrichment,
    "package_dedupe": package_dedupe,
    "manifest_authority": manifest_authority,
    "mined_merge": mined_merge,
    "mined_advisories": mined_advisories,
    "record_digests": record_digests,
    "snapshot_digest": snapshot_digest,
}
ORACLES = {
    "package_identity": PACKAGE_IDENTITY,
    "version_order": VERSION_ORDER,
    "version_extremes": VERSION_EXTREMES,
    "range_match": RANGE_MATCH,
    "version_list_match": VERSION_LIST_MATCH,
    "advisory_match": ADVISORY_MATCH,
    "fixed_versions": FIXED_VERSIONS,
    "osv_records": OSV_RECORDS,
    "epss_rows": _EPSS_SQL,
    "threat_enrichment": THREAT_SQL,
    "package_dedupe": PACKAGE_DEDUPE,
    "manifest_authority": MANIFEST_AUTHORITY,
    "mined_merge": MINED_MERGE,
    "mined_advisories": MINED_ADVISORIES,
    "record_digests": RECORD_DIGESTS,
    "snapshot_digest": SNAPSHOT_DIGEST,
}
