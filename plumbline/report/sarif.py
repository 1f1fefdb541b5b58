"""SARIF 2.1.0."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import TOOL_NAME, __version__
from plumbline.functions.text import basename, exact_round
from plumbline.report.document import as_json, document, finding_order, fixed, items, order_key
from plumbline.report.json_report import with_advisory_texts
from plumbline.report.manifest import ScanFacts


def level(band: Column) -> Column:
    return F.when(band.isin("CRITICAL", "HIGH"), "error").when(band == "MEDIUM", "warning").otherwise("note")


def rule_id() -> Column:
    return F.coalesce("vuln_id", F.concat(F.lit(f"{TOOL_NAME.upper()}-"), F.upper("kind")))


def security_severity() -> Column:
    """CVSS when there is a score, else a tenth of the risk."""
    score = F.col("cvss.base_score")
    return F.when(F.coalesce(score, F.lit(0.0)) != 0, exact_round(score, 1)).otherwise(exact_round(F.col("risk.value") / 10.0, 1))


def rules(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """``project, ord, text``: one rule per id, from its first finding."""
    ranked = findings.select("project", rule_id().alias("rule"), finding_order().alias("ord"), "kind", "title", "vuln_id", "cve")
    first = ranked.groupBy("project", "rule").agg(
        F.min_by(F.struct("kind", "title", "vuln_id", "cve"), "ord").alias("f"), F.min("ord").alias("ord")
    )
    rich = with_advisory_texts(first.select("project", "rule", "ord", "f.*"), advisories, ["details", "help_uri"], ["project", "rule"])
    body = F.struct(
        F.col("rule").alias("id"),
        F.replace("rule", F.lit("-"), F.lit("")).alias("name"),
        F.struct(F.left("title", F.lit(120)).alias("text")).alias("shortDescription"),
        F.struct(F.when(F.col("vuln_id").isNotNull(), F.left("details", F.lit(1000))).otherwise(F.col("title")).alias("text")).alias("fullDescription"),
        F.coalesce("help_uri", F.lit("")).alias("helpUri"),
        F.struct(F.array(F.lit("security"), F.lit("supply-chain"), F.col("kind")).alias("tags"), "cve").alias("properties"),
    )
    return rich.select("project", order_key(F.col("ord.n"), F.col("ord.a"), F.col("ord.b"), F.concat("ord.c", "rule")).alias("ord"), as_json(body).alias("text"))


def results(findings: DataFrame) -> DataFrame:
    """``project, ord, text``: one result per finding."""
    version = F.coalesce("version", F.lit("None"))
    message = F.concat(
        "name", F.lit("@"), version, F.lit(": "), "title", F.lit(" [risk "), F.col("risk.value").cast("string"), F.lit(" "), "risk.band",
        F.lit(", reachability "), "status", F.lit("]"),
    )
    uri = F.when(F.coalesce("source", F.lit("")) == "", "manifest").otherwise(basename(F.col("source")))
    body = F.struct(
        rule_id().alias("ruleId"),
        level(F.col("risk.band")).alias("level"),
        F.struct(message.alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.concat(rule_id(), F.lit("::"), "purl").alias(f"{TOOL_NAME}/v1")).alias("partialFingerprints"),
        F.struct(
            security_severity().cast("string").alias("security-severity"),
            F.col("risk.value").alias("risk"),
            F.col("risk.band").alias("riskBand"),
            F.col("status").alias("reachability"),
            F.col("symbol_hit").alias("symbolHit"),
            "epss",
            "kev",
            "confidence",
            F.col("fixed_versions").alias("fixedVersions"),
            "purl",
        ).alias("properties"),
    )
    return findings.select("project", finding_order().alias("ord"), as_json(body).alias("text"))


def render(findings: DataFrame, advisories: DataFrame, manifests: DataFrame, facts: ScanFacts) -> DataFrame:
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1]
    driver = json.dumps({"name": TOOL_NAME, "version": __version__})[:-1]
    tail = json.dumps({"dbSnapshot": facts.snapshot, "generatedAt": facts.generated_at})
    return document(
        fixed(manifests, 0, F.lit(f'{head}, "runs": [{{"tool": {{"driver": {driver}, "rules": [')),
        items(rules(findings, advisories), 1),
        fixed(manifests, 2, F.lit(']}}, "results": [')),
        items(results(findings), 3),
        fixed(manifests, 4, F.lit(f'], "properties": {tail}}}]}}')),
    )
