"""Joins, dealing and texts whose cost must not outgrow their input."""

import time

from pyspark.sql import functions as F

from plumbline.plans import derived
from plumbline.report import vex
from plumbline.sources import requirements
from plumbline.workload import reports

FOUND = "project string, kind string, name string, version string, vuln_id string, signal string, cve string, purl string, status string, proven_sink_unreachable boolean, fixed_versions array<string>, risk struct<value:double>"
TEXTS = "id string, aliases array<string>, summary string, details string, fix_commits array<string>, references array<struct<url:string>>"


def test_advisory_texts_are_not_gathered_for_a_broadcast(spark):
    row = ("p", "vulnerability", "n", "1", "V-1", None, None, "pkg:pypi/n@1", "reachable", False, ["2"], (5.0,))
    found = spark.createDataFrame([row, ("q", *row[1:4], "V-9", *row[5:])], FOUND)
    texts = spark.createDataFrame([("V-1", ["CVE-1"], "s", "d", [], [])], TEXTS)
    out = vex.statements(found, texts)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.project: r.aliases for r in out.select("project", F.get_json_object("text", "$.vulnerability.aliases").alias("aliases")).collect()}
    assert got == {"p": '["CVE-1"]', "q": None}


def test_long_lines_are_read_in_linear_time(spark):
    text = "a==1 " + "x" * 150_000 + "\nb==2" + " " * 150_000 + "\nc==3 \\\n  --hash=sha256:h\nd \\\n e \\"
    begun = time.time()
    lines = [r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(requirements.logical_lines(F.col("t")))).collect()]
    assert time.time() - begun < 10
    assert lines == ["a==1 " + "x" * 150_000, "b==2", "c==3    --hash=sha256:h"]


def test_a_table_in_one_part_is_dealt_over_all_tasks(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = derived.run(spark, str(tmp_path), "SELECT 'o' || CAST(o_orderkey AS STRING) AS t FROM {orders}", deal=("orders",))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.t for r in rows.collect()} == {f"o{i}" for i in range(100)}


def test_ranking_writes_only_what_it_needs(spark, monkeypatch):
    row = ("p", "vulnerability", "n", "1", "V-1", None, None, "pkg:pypi/n@1", "reachable", False, ["2"], (5.0,))
    found = spark.createDataFrame([row, ("q", *row[1:-1], (7.0,))], FOUND)
    monkeypatch.setattr(reports, "findings", lambda spark, sf: found)
    out = reports.ranked_findings(spark, "")
    assert [(r.project, r.ordinal) for r in out.orderBy("ordinal").collect()] == [("q", 1), ("p", 2)]
    assert "purl" not in spark.read.parquet(*out.inputFiles()).columns
