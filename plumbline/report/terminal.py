"""The ranked table for people, as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import TOOL_NAME, __version__
from plumbline.functions.text import basename, exact_round, pad
from plumbline.operators.reachability import reach_label
from plumbline.plans.scan import band_histogram
from plumbline.report.document import document, finding_order, fixed, order_key
from plumbline.report.evidence import with_evidence
from plumbline.report.manifest import ScanFacts

# Terminal colours.
COLOURS = {"CRITICAL": "1;97;41", "HIGH": "1;91", "MEDIUM": "1;93", "LOW": "1;94", "INFO": "2;37"}
DIM, BOLD, CYAN, GREEN, YELLOW = "2", "1", "96", "92", "33"
BANDS = list(COLOURS)


def _paint(on: bool, text: Column, code: Column | str) -> Column:
    if not on:
        return text
    mark = F.lit(code) if isinstance(code, str) else code
    return F.concat(F.lit("\033["), mark, F.lit("m"), text, F.lit("\033[0m"))


def _band_colour(band: Column) -> Column:
    out = F.lit(DIM)
    for name, code in COLOURS.items():
        out = F.when(band == name, code).otherwise(out)
    return out


def finding_cells(findings: DataFrame) -> DataFrame:
    """``project, ord`` and the unpadded cells of the table."""
    intel = F.concat_ws(
        " ",
        F.when(F.col("epss").isNotNull(), F.format_string("EPSS %4.1f%%", exact_round(F.col("epss") * 100, 1))),
        F.when(F.col("kev"), "KEV"),
    )
    names = ("status", "dynamic", "symbol_hit", "deep", "proven_sink_unreachable", "affected_fn_not_reached")
    return findings.select(
        "project",
        finding_order().alias("ord"),
        F.concat(F.format_string("%5.1f ", "risk.value"), F.left("risk.band", F.lit(4))).alias("risk_cell"),
        F.concat("name", F.lit("@"), F.coalesce("version", F.lit("?"))).alias("package_cell"),
        F.coalesce("vuln_id", "kind").alias("advisory_cell"),
        reach_label(*[F.col(n) for n in names]).alias("reach_cell"),
        F.when(intel == "", "—").otherwise(intel).alias("intel_cell"),
        F.coalesce(F.get("fixed_versions", F.lit(0)), F.lit("—")).alias("fix_cell"),
        F.col("risk.band").alias("band"),
    )


def table_lines(findings: DataFrame, colour: bool = False) -> DataFrame:
    """``project, ord, text``: one fixed-width line per finding."""
    cells = finding_cells(findings)
    reach_colour = F.when(F.col("reach_cell").rlike("^REACH"), GREEN).otherwise(DIM)
    fix_colour = F.when(F.col("fix_cell") == "—", DIM).otherwise(GREEN)
    text = F.concat(
        F.lit("  "),
        _paint(colour, pad(F.col("risk_cell"), 11), _band_colour(F.col("band"))),
        pad(F.col("package_cell"), 26),
        pad(F.col("advisory_cell"), 22),
        _paint(colour, pad(F.col("reach_cell"), 16), reach_colour),
        pad(F.col("intel_cell"), 16),
        _paint(colour, pad(F.col("fix_cell"), 12), fix_colour),
    )
    return cells.select("project", "ord", text.alias("text"))


def evidence_lines(findings: DataFrame, colour: bool = False) -> DataFrame:
    """``project, ord, text``: the evidence tree of every finding."""
    def row(n: Column, indent: str, glyph: Column) -> Column:
        weight = _paint(colour, F.format_string("[%.2f]", n["confidence"]), DIM)
        claim = F.concat(F.lit(indent), glyph, F.lit(" "), _paint(colour, n["kind"], CYAN), F.lit(" "), weight, F.lit(" "), n["claim"])
        return F.concat(claim, F.lit(f"\n{indent}   "), _paint(colour, F.concat(F.lit("source: "), n["source"]), DIM))

    about = F.coalesce("vuln_id", "title")
    head = F.concat("name", F.lit("@"), F.coalesce("version", F.lit("None")), F.lit("  →  "), about)
    e = F.col("evidence")
    branch = lambda n: F.when(n["kind"] == "enrichment", "└─").otherwise("├─")
    children = F.transform(e["children"], lambda n: row(n, " " * 11, branch(n)))
    block = F.concat(F.lit("\n  "), _paint(colour, head, CYAN), F.lit("\n"), row(e, " " * 8, F.lit("◆")), F.lit("\n"), F.array_join(children, "\n"))
    return with_evidence(findings).select("project", finding_order().alias("ord"), block.alias("text"))


def render(findings: DataFrame, manifests: DataFrame, facts: ScanFacts, explain: bool = False, colour: bool = False) -> DataFrame:
    paint = lambda text, code: _paint(colour, text, code)
    snap = facts.snapshot
    rule = lambda n: paint(F.lit("  " + "─" * n), DIM)
    db = "  vuln-db    " + " · ".join(str(snap.get(k, "?")) for k in ("source", "content_hash", "record_count")) + " records"
    counts = F.col("counts")
    warned = F.array_join(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("\n"), paint(F.concat(F.lit("  ⚠ "), w), YELLOW))), "")
    head = F.concat(
        paint(F.lit(f"  {TOOL_NAME}"), BOLD), paint(F.lit(f"  v{__version__}  ·  findings with their evidence"), DIM), F.lit("\n"), rule(78),
        F.lit("\n  target     "), "project", F.lit(f"\n  ecosystem  {facts.ecosystem}    packages "), counts["packages"].cast("string"),
        F.lit("  (direct "), counts["direct"].cast("string"), F.lit(")\n"), paint(F.lit(db), DIM), warned, F.lit("\n"),
    )
    bands = band_histogram(findings).groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("band", "findings"))).alias("b"))
    summary = manifests.select("project").join(bands, "project", "left")
    cell = lambda b: paint(F.concat(F.lit(f"{b} "), F.coalesce(F.try_element_at("b", F.lit(b)), F.lit(0)).cast("string")), COLOURS[b])
    bars = F.concat(F.lit("  "), F.concat_ws("  ", *[cell(b) for b in BANDS]), F.lit("\n"))
    columns = "".join(name.ljust(width) for name, width in (("RISK", 11), ("PACKAGE", 26), ("ADVISORY", 22), ("REACHABILITY", 16), ("THREAT-INTEL", 16), ("FIX", 12)))
    found = manifests.select("project", (counts["vulnerabilities"] + counts["supply_chain"] > 0).alias("any"))
    titles = F.when(F.col("any"), F.concat(F.lit("  "), paint(F.lit(columns), BOLD), F.lit("\n"), rule(98))).otherwise(paint(F.lit("  ✓ no findings"), GREEN))
    inputs = F.array_join(F.transform(F.coalesce("inputs", F.array().cast("array<struct<path:string,sha256:string>>")), lambda i: basename(i["path"])), ", ")
    foot = F.concat(F.lit("\n"), paint(F.lit(f"  generated  {facts.generated_at}"), DIM), F.lit("\n"), paint(F.concat(F.lit("  inputs     "), inputs), DIM))
    again = F.concat(F.lit(f"  reproduce  {TOOL_NAME} scan "), "project", F.lit(f" --db-snapshot {snap.get('content_hash', '')}"))
    foot = F.concat(foot, F.lit("\n"), paint(again, DIM))
    part = lambda df, n: df.select("project", F.lit(n).alias("part"), "ord", "text")
    parts = [fixed(manifests, 0, head), fixed(summary, 1, bars), fixed(found, 2, titles), part(table_lines(findings, colour), 3), fixed(found.where("any"), 4, rule(98))]
    if explain:
        parts += [fixed(found.where("any"), 5, paint(F.lit("\n  EVIDENCE"), BOLD)), part(evidence_lines(findings, colour), 6)]
    return document(*parts, fixed(manifests, 7, foot))
