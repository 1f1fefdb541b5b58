"""OpenVEX statements: is the product affected by each vulnerability?"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import TOOL_NAME, __version__
from plumbline.plans.digest import parallel_digest
from plumbline.report.document import as_json, document, finding_order, fixed, items
from plumbline.report.json_report import with_advisory_texts
from plumbline.report.manifest import ScanFacts

CONTEXT = "https://openvex.dev/ns/v0.2.0"
JUSTIFICATION = "vulnerable_code_not_in_execute_path"
IMPACT = "Static import-graph analysis shows the vulnerable distribution is not imported by first-party code."


def status() -> Column:
    return (
        F.when((F.col("status") == "unreachable") | F.col("proven_sink_unreachable"), "not_affected")
        .when(F.col("status") == "unknown", "under_investigation")
        .otherwise("affected")
    )


def statements(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """``project, ord, text``: one statement per vulnerability finding."""
    found = findings.where("kind = 'vulnerability'").withColumn("vex", status())
    rich = with_advisory_texts(found, advisories, ["aliases"], ["project", "name"])
    clear = F.col("vex") == "not_affected"
    action = F.when(
        (F.col("vex") == "affected") & (F.size("fixed_versions") > 0),
        F.concat(F.lit("Upgrade "), "name", F.lit(" to "), F.col("fixed_versions")[0], F.lit(" or later.")),
    )
    body = F.struct(
        F.struct(F.coalesce("cve", "vuln_id").alias("name"), F.col("vuln_id").alias("@id"), "aliases").alias("vulnerability"),
        F.array(F.struct(F.col("purl").alias("@id"))).alias("products"),
        F.col("vex").alias("status"),
        F.when(clear, JUSTIFICATION).alias("justification"),
        F.when(clear, IMPACT).alias("impact_statement"),
        action.alias("action_statement"),
    )
    return rich.select("project", finding_order().alias("ord"), as_json(body, keep_nulls=False).alias("text"))


def render(findings: DataFrame, advisories: DataFrame, manifests: DataFrame, facts: ScanFacts) -> DataFrame:
    """The document id is a digest of its statements, so equal content has an
    equal id; it is a parallel aggregate like the snapshot digest."""
    body = statements(findings, advisories)
    ids = parallel_digest(body, "text", keys=["project"]).select("project", F.left("digest", F.lit(24)).alias("id"))
    head = json.dumps({"author": f"{TOOL_NAME} {__version__}", "timestamp": facts.generated_at, "version": 1})[1:-1]
    named = manifests.select("project").join(ids, "project", "left")
    text = F.concat(
        F.lit(f'{{"@context": "{CONTEXT}", "@id": "https://openvex.dev/docs/{TOOL_NAME}/'), F.coalesce("id", F.lit("empty")), F.lit(f'", {head}, "statements": [')
    )
    return document(fixed(named, 0, text), items(body, 1), fixed(manifests, 2, F.lit("]}")))
