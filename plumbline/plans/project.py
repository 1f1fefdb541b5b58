"""Scanning folders: manifests, first-party code, dependency code and traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import VENDOR_DIRS
from plumbline.operators.supply_chain import popular_names
from plumbline.operators.traces import load_trace
from plumbline.plans.scan import ScanResult, SourceEvidence, advisory_facts, scan
from plumbline.report import cyclonedx, json_report, sarif, terminal, vex
from plumbline.report.manifest import ScanFacts, manifests
from plumbline.session import materialize
from plumbline.sources.files import is_directory, path_exists, read_whole_files, under_any_dir
from plumbline.sources.manifests import Resolution, read_project_files, resolve, scanned_projects
from plumbline.sources.pyfacts import shared_facts, source_facts
from plumbline.sources.tree import list_tree, read_tree
from plumbline.store import AdvisoryStore

# Where a project keeps its installed dependencies.
SITE_PACKAGES = r"^(?:(?:\.venv|venv|env)/lib/python[^/]*/site-packages|__pypackages__/[^/]*/lib)/"
FORMATS = ("terminal", "json", "sarif", "vex", "cyclonedx")


@dataclass
class ProjectScan:
    """A scan together with what its reports need."""

    result: ScanResult
    resolution: Resolution
    advisories: DataFrame
    facts: ScanFacts

    def manifests(self) -> DataFrame:
        return manifests(self.result.counts(self.resolution.projects), self.facts, self.resolution.used, self.resolution.warnings)

    def render(self, kind: str, min_risk: float = 0.0, explain: bool = False, colour: bool = False) -> DataFrame:
        """The report as an ordered table of fragments; counts are those of the
        whole scan, ``min_risk`` only limits what is listed."""
        found = self.result.at_least(min_risk) if min_risk else self.result.findings
        head = self.manifests()
        if kind == "json":
            return json_report.render(found, self.advisories, head)
        if kind == "sarif":
            return sarif.render(found, self.advisories, head, self.facts)
        if kind == "vex":
            return vex.render(found, self.advisories, head, self.facts)
        if kind == "cyclonedx":
            return cyclonedx.render(found, self.advisories, self.resolution.packages, self.resolution.edges, head, self.facts)
        if kind == "terminal":
            return terminal.render(found, head, self.facts, explain, colour)
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")


def read_code(spark: SparkSession, root: str, target: str, many: bool, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(first-party files, dependency files)`` below ``root``.

    Both come from one listing and are told apart there by their path inside the
    project: installed packages lie in well-known folders, vendored and build
    folders hold no first-party code and are never opened.
    """
    listing = list_tree(spark, root) if listing is None else listing

    def placed(rows: DataFrame) -> DataFrame:
        if not many:
            return rows.withColumn("project", F.lit(target)).withColumn("inner", F.col("path"))
        inner = F.regexp_replace("path", "^[^/]*/", "")
        return rows.where(F.col("path").contains("/")).withColumn("project", F.substring_index("path", "/", 1)).withColumn("inner", inner)

    def contents(which: Column) -> DataFrame:
        chosen = placed(listing).where(which).select("path", "size", "error")
        return placed(read_tree(spark, root, listing=chosen)).withColumn("path", F.col("inner")).drop("inner")

    first_party = contents(~under_any_dir(F.col("inner"), VENDOR_DIRS))
    folder = F.regexp_extract("path", SITE_PACKAGES, 0)
    # The order of the roots: virtual environments, then PEP 582 folders.
    order = F.when(folder.startswith(".venv"), "1").when(folder.startswith("venv"), "2").when(folder.startswith("env"), "3").otherwise("4")
    dependency = contents(F.col("inner").rlike(SITE_PACKAGES)).select(
        "project", F.concat(order, F.lit(":"), folder).alias("root_ix"), F.regexp_replace("path", SITE_PACKAGES, "").alias("path"), "content", "error"
    )
    return first_party.select("project", "path", "content", "error"), dependency


def read_dependency_roots(spark: SparkSession, roots: list[str], project: str) -> DataFrame | None:
    """Files of explicitly named dependency roots of one project."""
    found = None
    for i, root in enumerate(r.rstrip("/") for r in roots if path_exists(spark, r)):
        part = read_tree(spark, root).select(F.lit(project).alias("project"), F.lit(f"0:{i:05d}").alias("root_ix"), "path", "content", "error")
        found = part if found is None else found.unionByName(part)
    return found


def facts_or_errors(files: DataFrame, *carry: str, shared: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of the files, of these ``kinds`` if named; one that could not be read is an ``unparsed`` row with the error."""
    facts = (shared_facts if shared else source_facts)(files.where("error is null"), *carry, kinds=kinds)
    failed = files.where("error is not null").select(*carry, F.lit("unparsed").alias("kind"), F.col("error").alias("name"))
    return facts.unionByName(failed, allowMissingColumns=True)


def source_warnings(facts: DataFrame) -> DataFrame:
    """``project, message``: one line for each reason, with the number of files and the first of them."""
    bad = facts.where("kind = 'unparsed'").groupBy("project", "name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("first"))
    said = F.concat(F.col("n").cast("string"), F.lit(" source files could not be used ("), "name", F.lit("), first "), "first")
    return bad.select("project", said.alias("message"))


def scan_target(
    spark: SparkSession,
    store: AdvisoryStore,
    target: str,
    deps_paths: list[str] | None = None,
    trace_path: str | None = None,
    many: bool = False,
    popular_path: str | None = None,
    any_range_type: bool = True,
    prefer_scored: bool = False,
) -> ProjectScan:
    """Scan a folder or manifest file; with ``many`` every subfolder is a project.

    ``any_range_type=False`` and ``prefer_scored=True`` switch two lenient rules
    off: GIT ranges taking part in version matching, and an unscored CVSS v4
    entry hiding a scored v3 one.
    """
    if many and (deps_paths or trace_path):
        raise ValueError("dependency roots and traces belong to one project; name them without many=True")
    store = store.pinned()  # One version from the first read to the report.
    target = target.rstrip("/")
    is_dir = is_directory(spark, target)
    root = target if is_dir else target.rpartition("/")[0]
    listing = list_tree(spark, root)
    resolution = resolve(read_project_files(spark, target, is_dir, many, listing), scanned_projects(spark, root if is_dir else target, many))
    resolution.packages = materialize(resolution.packages, "resolved")
    resolution.edges = materialize(resolution.edges, "edges")
    own, installed = read_code(spark, root, target, many, listing)
    named = read_dependency_roots(spark, deps_paths or [], target)
    dep_files = installed if named is None else named.unionByName(installed)
    trace = None
    if trace_path and path_exists(spark, trace_path):
        trace = load_trace(read_whole_files(spark, trace_path)).withColumn("project", F.lit(target))
    # Read and parsed once: the written facts have a row for every file, also for those that are no valid Python.
    own_facts = materialize(facts_or_errors(own, "project", "path"), "ownfacts")
    dep_facts = materialize(facts_or_errors(dep_files, "project", "root_ix", "path", shared=True), "depfacts")
    files = own_facts.where("kind in ('file', 'unparsed')").select("project", "path").distinct()
    resolution.warnings = resolution.warnings.unionByName(source_warnings(own_facts)).unionByName(source_warnings(dep_facts))
    evidence = SourceEvidence(files=files, facts=own_facts.where("kind <> 'unparsed'"), dep_facts=dep_facts.where("kind <> 'unparsed'"), trace=trace)
    result = scan(
        resolution.packages, resolution.edges, store.index(any_range_type),
        advisory_facts(store.advisories, store.enrichment(), prefer_scored), popular_names(spark, popular_path), evidence,
    )
    result.packages = resolution.packages
    return ProjectScan(result, resolution, store.advisories, ScanFacts(store.info()))
