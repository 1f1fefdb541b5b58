"""Package, advisory and graph relations derived from the benchmark tables.

The tables hold orders and documents, not software. These statements read them
as an inventory: a part is a package, a line item an installed version in the
project of its order, an order an advisory about the package ``o_custkey``, a
supplier a group of projects. Each is one portable SQL statement, so the same
text serves Spark and the SQL a result is checked against.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a table that one task makes into texts.
TEXT_ROWS = 1 << 16


def dealt(df: DataFrame) -> DataFrame:
    """Deals the rows of a table over enough tasks for the texts that are made of them.

    A few numbers become much text, and parsing it costs far more than reading them:
    dealing the numbers keeps every core busy, and no text is ever shuffled. A table
    that comes in as many parts already is left as it is.
    """
    tasks = max(ceil(df.count() / TEXT_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def run(spark: SparkSession, sf_dir: str, statement: str, deal: tuple[str, ...] = ()) -> DataFrame:
    """Run a portable statement over the tables in ``sf_dir``; the tables in ``deal`` are dealt over all tasks first."""
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **{t: dealt(df) if t in deal else df for t, df in used.items()})


def portable(statement: str) -> str:
    """The same statement for an engine that has the tables as views."""
    return statement.format(**{t: t for t in TABLES})


PACKAGES = """
    SELECT p_partkey AS pkg,
           CASE p_partkey % 4 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'npm' WHEN 2 THEN 'Go' ELSE 'Maven' END AS ecosystem,
           upper(replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_.' WHEN 1 THEN '--' ELSE '.' END))
             || '-' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END AS raw_name,
           CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END AS version
    FROM {part}
"""

# Version text of a line item: release, optional pre, post, dev and local parts.
VERSION = """
    CASE WHEN l_suppkey % 29 = 0 THEN '1!' ELSE '' END
    || CAST(l_linenumber AS STRING) || '.' || CAST(CAST(floor(l_quantity) AS INT) AS STRING)
    || CASE l_partkey % 4 WHEN 0 THEN '.0' ELSE '' END
    || CASE l_returnflag WHEN 'A' THEN 'a' || CAST(l_suppkey % 3 AS STRING)
                         WHEN 'R' THEN '.RC' || CAST(l_suppkey % 12 AS STRING) ELSE '' END
    || CASE WHEN l_linestatus = 'F' AND l_partkey % 5 = 0 THEN '.post' || CAST(l_orderkey % 11 AS STRING) ELSE '' END
    || CASE WHEN l_partkey % 7 = 0 THEN '.dev' || CAST(l_orderkey % 13 AS STRING) ELSE '' END
    || CASE WHEN l_orderkey % 17 = 0 THEN '+b.' || CAST(l_suppkey % 21 AS STRING) ELSE '' END
"""

# The same version as columns of numbers, for checks that do not parse text.
VERSION_NUMBERS = """
    CASE WHEN l_suppkey % 29 = 0 THEN 1 ELSE 0 END AS v_epoch,
    l_linenumber AS v_major,
    CAST(floor(l_quantity) AS INT) AS v_minor,
    CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2
         WHEN l_partkey % 7 = 0 AND NOT (l_linestatus = 'F' AND l_partkey % 5 = 0) THEN 0 ELSE 9 END AS v_pre,
    CASE WHEN l_returnflag = 'A' THEN l_suppkey % 3 WHEN l_returnflag = 'R' THEN l_suppkey % 12 ELSE 0 END AS v_pre_n,
    CASE WHEN l_linestatus = 'F' AND l_partkey % 5 = 0 THEN l_orderkey % 11 ELSE -1 END AS v_post,
    CASE WHEN l_partkey % 7 = 0 THEN l_orderkey % 13 ELSE 99 END AS v_dev,
    CASE WHEN l_orderkey % 17 = 0 THEN l_suppkey % 21 ELSE -1 END AS v_local
"""

CONFIDENCE = "CASE l_orderkey % 4 WHEN 0 THEN 'lockfile' WHEN 1 THEN 'pinned' WHEN 2 THEN 'constrained' ELSE 'lockfile' END"

INSTALLS = f"""
    SELECT CAST(l_orderkey AS STRING) AS project, 'PyPI' AS ecosystem,
           'pkg-' || CAST(l_partkey AS STRING) AS name, {VERSION} AS version,
           l_partkey, l_suppkey, l_orderkey, l_linenumber,
           {CONFIDENCE} AS confidence, l_linenumber % 2 = 1 AS direct,
           'requirements.txt' AS source, {VERSION_NUMBERS}
    FROM {{lineitem}}
"""

# An advisory opens at i.0, is fixed at (i+w).q, and, for some, opens again at
# i+4.0 with a last affected version.
ADVISORY_NUMBERS = """
    SELECT o_orderkey, o_custkey,
           'SYN-' || CAST(o_orderkey AS STRING) AS vuln_id,
           'pkg-' || CAST(o_custkey AS STRING) AS name,
           CAST(o_orderkey % 5 AS INT) AS i,
           CAST(o_orderkey % 5 + 1 + o_orderkey % 3 AS INT) AS f,
           CAST(o_custkey % 40 AS INT) AS q,
           CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5 + 4 AS INT) END AS i2,
           CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 50 AS INT) END AS la,
           CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 7 + 1 AS STRING) || '.' || CAST(o_custkey % 50 + 1 AS STRING) END AS listed,
           CASE WHEN o_orderkey % 11 = 0 THEN '2024-01-01T00:00:00Z' END AS withdrawn,
           CASE WHEN o_orderkey % 3 > 0 THEN 'CVE-2024-' || CAST(o_orderkey AS STRING) END AS cve1,
           CASE WHEN o_orderkey % 3 = 2 THEN 'cve-2023-' || CAST(o_custkey AS STRING) END AS cve2,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'N' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'L' ELSE 'P' END AS av,
           CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'H' END AS ac,
           CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END AS pr,
           CASE WHEN o_custkey % 2 = 0 THEN 'N' ELSE 'R' END AS ui,
           CASE WHEN o_orderkey % 7 < 3 THEN 'C' ELSE 'U' END AS sc,
           CASE o_orderstatus WHEN 'F' THEN 'H' WHEN 'O' THEN 'L' ELSE 'N' END AS c,
           CASE o_custkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END AS ig,
           CASE o_orderkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END AS av2,
           CAST(o_orderdate AS DATE) AS modified
    FROM {orders}
"""

VECTOR = "'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || sc || '/C:' || c || '/I:' || ig || '/A:' || av2"

# The advisory as an OSV document.
OSV_TEXT = f"""
    SELECT o_orderkey, '{{{{"id":"' || vuln_id || '","modified":"' || CAST(modified AS STRING) || '"'
      || ',"summary":"Issue in ' || name || '"'
      || CASE WHEN withdrawn IS NULL THEN '' ELSE ',"withdrawn":"' || withdrawn || '"' END
      || ',"aliases":[' || coalesce('"' || cve1 || '"', '') || coalesce(',"' || cve2 || '"', '') || ']'
      || CASE o_orderkey % 10
           WHEN 9 THEN ''
           WHEN 8 THEN ',"severity":[{{{{"type":"CVSS_V3","score":"' || {VECTOR} || '"}}}},{{{{"type":"CVSS_V4","score":"CVSS:4.0/AV:N"}}}}]'
           WHEN 7 THEN ',"database_specific":{{{{"cvss":{{{{"score":' || CAST(o_custkey % 10 AS STRING) || '.5,"version":"3.0"}}}}}}}}'
           ELSE ',"severity":[{{{{"type":"CVSS_V3","score":"' || {VECTOR} || '"}}}}]' END
      || ',"references":[{{{{"type":"WEB","url":"https://example.org/' || vuln_id || '"}}}},{{{{"type":"FIX","url":"https://example.org/commit/' || CAST(o_orderkey AS STRING) || '"}}}}]'
      || ',"affected":[{{{{"package":{{{{"ecosystem":"PyPI","name":"' || upper(replace(name, '-', '_')) || '"}}}}'
      || ',"database_specific":{{{{"affected_functions":["mod' || CAST(o_orderkey % 5 AS STRING) || '.fn' || CAST(o_orderkey % 9 AS STRING) || '","fn' || CAST(o_custkey % 9 AS STRING) || '"]}}}}'
      || CASE WHEN listed IS NULL THEN '' ELSE ',"versions":["' || listed || '"]' END
      || ',"ranges":[{{{{"type":"ECOSYSTEM","events":[{{{{"introduced":"' || CASE WHEN i = 0 THEN '0' ELSE CAST(i AS STRING) || '.0' END || '"}}}},'
      || '{{{{"fixed":"' || CAST(f AS STRING) || '.' || CAST(q AS STRING) || '"}}}}'
      || coalesce(',{{{{"introduced":"' || CAST(i2 AS STRING) || '.0"}}}},{{{{"last_affected":"' || CAST(i2 AS STRING) || '.' || CAST(la AS STRING) || '"}}}}', '')
      || ']}}}}]}}}}]}}}}' AS content
    FROM ({ADVISORY_NUMBERS}) n
"""

# Threat intelligence for the CVE ids above, as rows of a feed file: some numbers
# are missing or broken, some CVEs are listed again further down, and some lines
# are about CVEs that no advisory names.
EPSS = """
    SELECT cve, line, '0.' || lpad(CAST(k * 7 % 1000 AS STRING), 3, '0') AS percentile,
           CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 17 = 0 THEN '' ELSE '0.' || lpad(CAST(k % 1000 AS STRING), 3, '0') END AS epss
    FROM (
      SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'CVE-2019-' ELSE 'CVE-2024-' END || CAST(o_orderkey AS STRING) AS cve, o_orderkey AS k, o_orderkey AS line
      FROM {orders}
      UNION ALL
      SELECT CASE WHEN c_custkey % 5 = 4 THEN 'cve-2018-' ELSE 'cve-2023-' END || CAST(c_custkey AS STRING), c_custkey, c_custkey
      FROM {customer}
      UNION ALL
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'CVE-2024-' ELSE 'CVE-2017-' END || CAST(o_orderkey AS STRING), o_orderkey + 501, o_orderkey + 1000000000000
      FROM {orders}
    ) f
"""
KEV = """
    SELECT CASE WHEN c_custkey % 9 = 0 THEN 'CVE-2023-' ELSE 'CVE-2016-' END || CAST(c_custkey AS STRING) AS cve,
           '2024-02-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS date_added
    FROM {customer}
"""

# ---------------------------------------------------------------------------
# Source code. Every line item is a module of its order's project that treats
# package ``l_partkey`` in one of six ways; two of three orders also have a
# module ``shared`` that calls package ``o_custkey``, the others one that calls nothing.
# ---------------------------------------------------------------------------
_MODULE = "'m' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING)"
_PKG = "'pkg_' || CAST(l_partkey AS STRING)"
_FN = "'fn' || CAST(l_suppkey % 9 AS STRING)"
_ENTRY = "'entry' || CAST(l_suppkey % 4 AS STRING)"
_NL = "chr(10)"
_SHAPE = "CAST(floor(l_partkey / 6) AS INT) % 3"
SOURCES = f"""
    SELECT CAST(l_orderkey AS STRING) AS project, {_MODULE} || '.py' AS path,
      CASE l_partkey % 6
        WHEN 0 THEN 'from ' || {_PKG} || ' import ' || {_FN} || {_NL} || 'def run():' || {_NL} || '    return ' || {_FN} || '(1)' || {_NL} || 'run()' || {_NL}
        WHEN 1 THEN 'import ' || {_PKG} || ' as p' || {_NL} || 'class Job:' || {_NL} || '    def go(self):' || {_NL} || '        return self.step()' || {_NL}
                    || '    def step(self):' || {_NL} || '        return p.' || {_ENTRY} || '()' || {_NL} || 'Job().go()' || {_NL}
        WHEN 2 THEN 'import ' || {_PKG} || {_NL} || 'from shared import common' || {_NL} || 'def work():' || {_NL} || '    call = ' || {_PKG} || '.' || {_ENTRY} || {_NL}
                    || '    return call()' || {_NL} || 'work()' || {_NL} || 'common()' || {_NL}
        WHEN 3 THEN 'from ' || {_PKG} || ' import ' || {_FN} || {_NL} || 'def unused():' || {_NL} || '    return ' || {_FN} || '()' || {_NL}
        WHEN 4 THEN 'def broken(:' || {_NL}
        ELSE 'import importlib' || {_NL} || 'importlib.import_module("' || {_PKG} || '.sub")' || {_NL} END AS content
    FROM {{lineitem}}
    UNION ALL
    SELECT CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 'other.py' ELSE 'shared.py' END,
      CASE WHEN o_orderkey % 3 = 0 THEN 'x = 1' || {_NL} ELSE
      'import pkg_' || CAST(o_custkey AS STRING) || ' as q' || {_NL} || 'def common():' || {_NL} || '    return q.fn' || CAST(o_orderkey % 9 AS STRING) || '()' || {_NL} END
    FROM {{orders}}
"""

# Sources of the installed packages: in one third the public entries lead to the
# function fn<k % 9>, in one third they lead nowhere; for the rest only a folder of another name is there.
DEP_SOURCES = f"""
    SELECT DISTINCT CAST(l_orderkey AS STRING) AS project, CASE WHEN {_SHAPE} = 2 THEN 'stub_' ELSE '' END || {_PKG} || '/__init__.py' AS path, 0 AS root_ix,
      CASE WHEN {_SHAPE} = 2 THEN 'x = 1' || {_NL} ELSE 'def entry0():' || {_NL} || '    return inner()' || {_NL} || 'def entry1():' || {_NL} || '    return inner()' || {_NL}
      || 'def entry2():' || {_NL} || '    return inner()' || {_NL} || 'def entry3():' || {_NL} || '    return inner()' || {_NL}
      || CASE WHEN {_SHAPE} = 0 THEN 'def inner():' || {_NL} || '    return fn' || CAST(l_partkey % 9 AS STRING) || '(0)' || {_NL} ELSE '' END
      || CASE WHEN l_partkey % 7 = 0 THEN 'import os, base64' || {_NL} || 'os.system("id")' || {_NL} || 'exec(base64.b64decode("eA=="))' || {_NL}
              WHEN l_partkey % 7 = 1 THEN 'import subprocess' || {_NL} || 'def setup():' || {_NL} || '    subprocess.run([])' || {_NL} ELSE '' END END AS content
    FROM {{lineitem}}
"""

TRACE = """
    SELECT CAST(l_orderkey AS STRING) AS project, 'mod' || CAST(l_suppkey % 5 AS STRING) AS module, 'fn' || CAST(l_linenumber AS STRING) AS func
    FROM {lineitem}
"""

# Within a project a package depends on the one of the next line.
DEPENDS = """
    SELECT DISTINCT CAST(a.l_orderkey AS STRING) AS project, 'pkg-' || CAST(a.l_partkey AS STRING) AS src, 'pkg-' || CAST(b.l_partkey AS STRING) AS dst
    FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
"""

# A cyclic graph with hubs for each kind of line: parts that follow each other in
# an order, and back to part 7 from every first line. Walks start at the least part.
HUB_EDGES = """
    SELECT a.l_returnflag || a.l_linestatus AS project, CAST(a.l_partkey AS STRING) AS src,
           CASE WHEN a.l_linenumber = 1 THEN '7' ELSE CAST(coalesce(b.l_partkey, a.l_suppkey) AS STRING) END AS dst
    FROM {lineitem} a LEFT JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
"""
HUB_SEEDS = """
    SELECT l_returnflag || l_linestatus AS project, CAST(min(l_partkey) AS STRING) AS node FROM {lineitem} GROUP BY l_returnflag || l_linestatus
"""
