"""CycloneDX 1.5: components, dependencies and vulnerabilities."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import TOOL_NAME, __version__
from plumbline.functions.identity import coordinate
from plumbline.report.document import as_json, document, finding_order, fixed, items, order_key
from plumbline.report.json_report import with_advisory_texts
from plumbline.report.manifest import ScanFacts


def _coordinate() -> Column:
    return coordinate(F.col("ecosystem"), F.col("name"))


def components(packages: DataFrame) -> DataFrame:
    """``project, ord, text``: one component per package, with its first hash."""
    first = F.get("hashes", F.lit(0))
    has_tag = F.coalesce(first.contains(":"), F.lit(False))
    algorithm = F.when(first.startswith("sha512:"), "SHA-512").otherwise("SHA-256")
    content = F.when(has_tag, F.regexp_replace(first, "^[^:]*:", "")).otherwise(first)
    body = F.struct(
        F.lit("library").alias("type"),
        "name",
        F.coalesce("version", F.lit("unknown")).alias("version"),
        _coordinate().alias("purl"),
        F.when(F.coalesce(first, F.lit("")) != "", F.array(F.struct(algorithm.alias("alg"), content.alias("content")))).alias("hashes"),
    )
    return packages.select("project", order_key(a=F.col("name")).alias("ord"), as_json(body, keep_nulls=False).alias("text"))


def dependencies(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, ord, text``: what each package depends on (known packages only)."""
    eco = packages.select("project", F.col("name").alias("dst"), _coordinate().alias("ref"))
    known = edges.join(eco, ["project", "dst"]).groupBy("project", F.col("src").alias("name")).agg(F.sort_array(F.collect_set("ref")).alias("refs"))
    body = F.struct(_coordinate().alias("ref"), F.coalesce("refs", F.array().cast("array<string>")).alias("dependsOn"))
    return packages.join(known, ["project", "name"], "left").select("project", order_key(a=F.col("name")).alias("ord"), as_json(body).alias("text"))


def analysis() -> tuple[Column, Column]:
    """``(state, detail)`` of a finding."""
    reachable = F.col("status") == "reachable"
    refuted = (F.col("status") == "unreachable") | F.col("proven_sink_unreachable")
    state = F.when(reachable, "exploitable").when(refuted, "not_affected").otherwise("in_triage")
    detail = (
        F.when(reachable & F.col("symbol_hit"), "Vulnerable function is directly invoked.")
        .when(reachable, "Package is imported but vulnerable function invocation not proven.")
        .when(refuted, "Package is never imported or vulnerable function is unreachable.")
        .otherwise("Reachability analysis could not conclusively determine exposure.")
    )
    return state, detail


def vulnerabilities(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """``project, ord, text``: one entry per vulnerability finding."""
    rich = with_advisory_texts(findings.where("kind = 'vulnerability'"), advisories, ["summary"], ["project", "name"])
    state, detail = analysis()
    rating = F.struct(
        F.struct(F.when(F.col("vuln_id").contains("CVE"), "NVD").otherwise("OSV").alias("name")).alias("source"),
        F.col("cvss.base_score").alias("score"),
        F.lower("risk.band").alias("severity"),
        F.concat(F.lit("CVSSv"), "cvss.version").alias("method"),
        F.col("cvss.vector").alias("vector"),
    )
    body = F.struct(
        F.col("vuln_id").alias("id"),
        F.struct(F.lit("OSV").alias("name")).alias("source"),
        F.array(F.struct(_coordinate().alias("ref"))).alias("affects"),
        F.when(F.col("cvss").isNotNull(), F.array(rating)).alias("ratings"),
        F.struct(state.alias("state"), detail.alias("detail")).alias("analysis"),
        F.nullif("summary", F.lit("")).alias("description"),
    )
    return rich.select("project", finding_order().alias("ord"), as_json(body, keep_nulls=False).alias("text"))


def render(findings: DataFrame, advisories: DataFrame, packages: DataFrame, edges: DataFrame, manifests: DataFrame, facts: ScanFacts) -> DataFrame:
    serial = str(facts.snapshot.get("content_hash", "unknown")).replace("sha256:", "")[:32].ljust(32, "0")
    tool = {"type": "application", "name": TOOL_NAME, "version": __version__}
    head = json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.5", "serialNumber": f"urn:uuid:{serial}", "version": 1})[:-1]
    meta = json.dumps({"timestamp": facts.generated_at, "tools": {"components": [tool]}})[:-1]
    own = F.to_json(F.struct(F.lit("application").alias("type"), F.col("project").alias("name")))
    roots = packages.where("direct").select("project", order_key(a=F.col("name")).alias("ord"), F.concat(F.lit('"'), _coordinate(), F.lit('"')).alias("text"))
    own_ref = F.regexp_replace(F.to_json(F.struct(F.col("project").alias("ref"))), r"\}$", ', "dependsOn": [')
    return document(
        fixed(manifests, 0, F.concat(F.lit(f'{head}, "metadata": {meta}, "component": '), own, F.lit('}, "components": ['))),
        items(components(packages), 1),
        fixed(manifests, 2, F.concat(F.lit('], "dependencies": ['), own_ref)),
        items(roots, 3),
        fixed(manifests, 4, F.lit("]}")),
        dependencies(packages, edges).select("project", F.lit(5).alias("part"), "ord", F.concat(F.lit(","), "text").alias("text")),
        fixed(manifests, 6, F.lit('], "vulnerabilities": [')),
        items(vulnerabilities(findings, advisories), 7),
        fixed(manifests, 8, F.lit("]}")),
    )
