"""Folder scanning, over a tree of files written from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import derived
from plumbline.plans.project import read_code
from plumbline.session import scratch_dir
from plumbline.sources.manifests import read_project_files, resolve, scanned_projects
from plumbline.sources.tree import list_tree

# A project for each nation. Its manifest lists its suppliers and includes a file with its parts, which includes the manifest
# again; customers are source files, some of them installed packages, some vendored. Notes belong to nothing.
_TREE = """
    SELECT 'n' || CAST(n_nationkey AS STRING) || '/requirements.txt' AS path,
           concat_ws('\n', '-r more/parts.list', array_join(array_sort(collect_list('Sup_' || CAST(s_suppkey AS STRING) || '==1.' || CAST(s_suppkey % 9 AS STRING))), '\n')) AS content
    FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_nationkey
    UNION ALL
    SELECT 'n' || CAST(p_partkey % 25 AS STRING) || '/more/parts.list',
           concat_ws('\n', array_join(array_sort(collect_list('part-' || CAST(p_partkey AS STRING) || '>=' || CAST(p_size AS STRING))), '\n'), '-r ../requirements.txt')
    FROM {part} GROUP BY p_partkey % 25
    UNION ALL
    SELECT 'n' || CAST(c_nationkey AS STRING) || '/' || CASE c_custkey % 4
             WHEN 0 THEN '.venv/lib/python3/site-packages/' WHEN 1 THEN 'node_modules/' ELSE 'src/' END || 'm' || CAST(c_custkey AS STRING) || '/__init__.py',
           '# ' || c_name AS content
    FROM {customer}
    UNION ALL
    SELECT 'n' || CAST(c_nationkey AS STRING) || '/notes/' || CAST(c_custkey AS STRING) || '.txt', 'note==1.0' FROM {customer} WHERE c_custkey % 4 = 2
"""


def write_tree(files: DataFrame, root: str) -> None:
    """Writes the rows ``path, content`` as files below ``root``, each by the task that holds it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.encode())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(write, "path string").count()


def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The packages, first-party and installed sources of all projects in a folder."""
    root = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    write_tree(derived.run(spark, sf, _TREE, deal=("customer",)), root)
    listing = list_tree(spark, root)
    found = resolve(read_project_files(spark, root, True, True, listing), scanned_projects(spark, root, True)).packages
    own, installed = read_code(spark, root, root, True, listing)
    fact = lambda what, about, value: ("project", F.lit(what).alias("what"), about.alias("about"), value.alias("value"))
    version = F.concat_ws(" ", F.coalesce("version", F.lit("-")), "confidence", F.substring_index("source", "/", -1))
    return (
        found.select(*fact("package", F.col("name"), version))
        .unionByName(own.select(*fact("source", F.col("path"), F.col("content"))))
        .unionByName(installed.select(*fact("installed", F.concat("root_ix", "path"), F.col("content"))))
    )


FOLDER_SCAN = """
SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS project, 'package' AS what, 'sup-' || CAST(s_suppkey AS VARCHAR) AS about,
       '1.' || CAST(s_suppkey % 9 AS VARCHAR) || ' pinned requirements.txt' AS value
FROM supplier
UNION ALL SELECT 'n' || CAST(p_partkey % 25 AS VARCHAR), 'package', 'part-' || CAST(p_partkey AS VARCHAR), '- constrained parts.list' FROM part
UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'source', 'src/m' || CAST(c_custkey AS VARCHAR) || '/__init__.py', '# ' || c_name FROM customer WHERE c_custkey % 4 > 1
UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'installed', '1:.venv/lib/python3/site-packages/m' || CAST(c_custkey AS VARCHAR) || '/__init__.py', '# ' || c_name
FROM customer WHERE c_custkey % 4 = 0
"""

QUERIES = {"folder_scan": folder_scan}
ORACLES = {"folder_scan": FOLDER_SCAN}
