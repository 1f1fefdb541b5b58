"""Lock files: poetry, uv, pdm (TOML) and Pipfile (JSON); pyproject roots.

Spark has no TOML reader, so a TOML text is turned into JSON text by a small
vectorised helper; everything after that is ``from_json`` and columns.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.identity import purl, pypi_name
from plumbline.functions.text import let
from plumbline.functions.versions import is_version
from plumbline.sources.requirements import parse_requirement

PACKAGE_COLUMNS = [
    "project", "ecosystem", "name", "raw_name", "version", "purl", "direct",
    "confidence", "hashes", "depends_on", "source", "manifest", "place",
]

POETRY = """
    package ARRAY<STRUCT<name: STRING, version: STRING, files: ARRAY<STRUCT<hash: STRING>>,
                         dependencies: MAP<STRING, STRING>>>,
    metadata STRUCT<files: MAP<STRING, ARRAY<STRUCT<hash: STRING>>>>
"""
UV = """
    package ARRAY<STRUCT<name: STRING, version: STRING, source: MAP<STRING, STRING>,
                         sdist: STRUCT<hash: STRING>, wheels: ARRAY<STRUCT<hash: STRING>>,
                         dependencies: ARRAY<STRUCT<name: STRING>>>>
"""
PDM = """
    package ARRAY<STRUCT<name: STRING, version: STRING, files: ARRAY<STRUCT<hash: STRING>>,
                         dependencies: ARRAY<STRING>>>
"""
# Entries stay text at first, so that one malformed entry cannot spoil the rest.
PIPFILE = "`default` MAP<STRING, STRING>, develop MAP<STRING, STRING>"
PIPFILE_ENTRY = "version STRING, hashes ARRAY<STRING>"
PYPROJECT = """
    project STRUCT<dependencies: ARRAY<STRING>>,
    tool STRUCT<poetry: STRUCT<dependencies: MAP<STRING, STRING>>>
"""


@F.pandas_udf(StringType())
def toml_to_json(texts: pd.Series) -> pd.Series:
    def convert(text: str) -> str | None:
        try:
            return json.dumps(tomllib.loads(text), default=str)
        except (tomllib.TOMLDecodeError, TypeError):
            return None

    return texts.map(convert)


def _texts(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def _hashes(files: Column) -> Column:
    return F.filter(_texts(F.transform(files, lambda f: f["hash"])), lambda h: F.coalesce(h, F.lit("")) != "")


def _packages(rows: DataFrame, raw_name: Column, version: Column, hashes: Column, deps: Column, direct: Column) -> DataFrame:
    """Package rows in the common shape; an invalid version becomes NULL."""
    eco = F.lit("PyPI")
    raw = F.coalesce(raw_name, F.lit(""))
    return rows.select(
        "project",
        eco.alias("ecosystem"),
        pypi_name(raw).alias("name"),
        raw.alias("raw_name"),
        F.when(is_version(version), version).alias("version"),
        purl(eco, pypi_name(raw), version).alias("purl"),
        direct.alias("direct"),
        F.lit("lockfile").alias("confidence"),
        _texts(hashes).alias("hashes"),
        _texts(deps).alias("depends_on"),
        F.col("path").alias("source"),
        F.col("path").alias("manifest"),
        F.array("pos").alias("place"),
    )


def poetry_packages(files: DataFrame) -> DataFrame:
    """Packages of poetry.lock files ``project, path, json``."""
    doc = files.select("project", "path", F.from_json("json", POETRY).alias("d"))
    rows = doc.select("project", "path", F.col("d.metadata.files").alias("old"), F.posexplode("d.package").alias("pos", "p"))
    raw = F.coalesce(F.col("p.name"), F.lit(""))
    pick = lambda *options: F.coalesce(*[F.when(F.size(o) > 0, o) for o in options])
    files_of = pick(
        F.col("p.files"), F.try_element_at(F.col("old"), raw), F.try_element_at(F.col("old"), pypi_name(raw))
    )
    deps = F.transform(F.map_keys("p.dependencies"), pypi_name)
    return _packages(rows, F.col("p.name"), F.col("p.version"), _hashes(files_of), deps, F.lit(False))


def uv_packages(files: DataFrame) -> DataFrame:
    """Packages of uv.lock files; the project's own entries are skipped."""
    doc = files.select("project", "path", F.from_json("json", UV).alias("d"))
    rows = doc.select("project", "path", F.posexplode("d.package").alias("pos", "p"))
    own = F.arrays_overlap(F.coalesce(F.map_keys("p.source"), F.array()), F.array(F.lit("virtual"), F.lit("editable")))
    archives = F.concat(
        F.array(F.col("p.sdist")), F.coalesce(F.col("p.wheels"), F.array().cast("array<struct<hash:string>>"))
    )
    named = F.filter(F.transform("p.dependencies", lambda d: d["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return _packages(
        rows.where(~own), F.col("p.name"), F.col("p.version"), _hashes(archives), F.transform(named, pypi_name), F.lit(False)
    )


def pdm_packages(files: DataFrame) -> DataFrame:
    """Packages of pdm.lock files; dependencies are requirement strings."""
    doc = files.select("project", "path", F.from_json("json", PDM).alias("d"))
    rows = doc.select("project", "path", F.posexplode("d.package").alias("pos", "p"))
    names = F.transform("p.dependencies", lambda d: F.regexp_extract(d, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    deps = F.transform(F.filter(names, lambda n: n != ""), pypi_name)
    return _packages(rows, F.col("p.name"), F.col("p.version"), _hashes(F.col("p.files")), deps, F.lit(False))


def pipfile_packages(files: DataFrame) -> DataFrame:
    """Packages of Pipfile.lock files: ``default`` is direct, ``develop`` is not."""
    doc = files.select("project", "path", F.from_json("json", PIPFILE).alias("d"))
    kind = lambda section, direct: let(
        F.coalesce(F.map_entries(F.col("d")[section]), F.array()),
        lambda entries: F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.from_json(e["value"], PIPFILE_ENTRY).alias("spec"), F.lit(direct).alias("direct"))),
    )
    rows = doc.select("project", "path", F.posexplode(F.concat(kind("default", True), kind("develop", False))).alias("pos", "p"))
    version = F.nullif(F.ltrim(F.coalesce(F.col("p.spec.version"), F.lit("")), F.lit("=")), F.lit(""))
    return _packages(rows, F.col("p.name"), version, F.col("p.spec.hashes"), F.lit(None).cast("array<string>"), F.col("p.direct"))


def pyproject_roots(files: DataFrame) -> DataFrame:
    """``project, name``: declared dependencies of pyproject.toml files."""
    doc = files.select("project", F.from_json(toml_to_json("content"), PYPROJECT).alias("d"))
    listed = doc.select("project", F.explode("d.project.dependencies").alias("text")).select(
        "project", parse_requirement(F.col("text"))["canonical"].alias("name")
    )
    keyed = doc.select("project", F.explode(F.map_keys("d.tool.poetry.dependencies")).alias("key")).where(
        F.lower("key") != "python"
    )
    return listed.where("name is not null").union(keyed.select("project", pypi_name(F.col("key")))).distinct()
