"""Steps that must not move, parse or write the same thing twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import diff, matching, supply_chain
from plumbline.operators.enrichment import enrich
from plumbline.plans.project import facts_or_errors
from plumbline.report import document
from plumbline.session import materialize
from plumbline.sources import manifests, requirements
from plumbline.sources.advisories import latest_records, sorted_latest_records
from plumbline.sources.pyfacts import shared_facts
from plumbline.store import AdvisoryStore, affected_names
from plumbline.streaming import feeds
from plumbline.workload import coverage, folders


def test_reports_are_written_packed(spark, tmp_path):
    rows = spark.range(4000).select(
        F.lit("p").alias("project"), F.lit(1).alias("part"), document.order_key(F.col("id")).alias("ord"),
        F.concat(F.lit('{"kind": "vulnerability", "reachability": {"status": "unknown"}, "n": '), F.col("id").cast("string"), F.lit("}")).alias("text"),
    )
    sizes, texts = [], []
    for packed in (None, "gzip"):
        where = tmp_path / str(packed)
        document.write(rows, str(where), packed)
        sizes.append(sum(f.stat().st_size for f in where.rglob("part-*")))
        texts.append(sorted(r.value for r in spark.read.schema("value string, project string").text(str(where)).collect()))
    assert texts[0] == texts[1] and len(texts[0]) == 4000
    assert sizes[1] * 4 < sizes[0]


def test_warnings_take_only_their_facts(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("p", "a.py", "x = f(1)\n", None), ("p", "b.py", "def (", None), ("p", "c.py", None, "OSError: x")], "project string, path string, content string, error string")
    got = facts_or_errors(files, "project", "path", kinds=("unparsed",))
    assert {(r.path, r.kind, r.name) for r in got.collect()} == {("b.py", "unparsed", "SyntaxError"), ("c.py", "unparsed", "OSError: x")}
    monkeypatch.setattr(coverage, "spread", lambda *_: 1 / 0)  # deals texts; the rows they are made of are dealt instead
    lines = "SELECT 1L AS l_orderkey, 4L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber"
    spark.sql(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 3L AS o_orderkey, 1L AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    said = {(r.project, r.message) for r in coverage.unusable_sources(spark, str(tmp_path)).collect()}
    assert said == {("1", "1 source files could not be used (SyntaxError), first m1_4_1.py"), ("3", "1 source files could not be used (OSError: denied), first other.py")}


def test_dependency_facts_are_read_once(spark):
    bad = "import os\nos.system('x')\n"
    files = spark.createDataFrame([("p", 0, "a_b/__init__.py", "x = 1\n"), ("p", 1, "a_b/__init__.py", bad), ("p", 1, "c.py", bad), ("p", 0, "d/e.py", bad), (None, 0, "c.py", bad)], "project string, root_ix int, path string, content string")
    direct = spark.createDataFrame([("p", "a-b"), ("p", "c"), ("p", "d"), ("q", "c"), (None, "c"), ("p", None)], "project string, name string")
    found = supply_chain.behaviour_signals(direct, shared_facts(files, "project", "root_ix", "path"))
    assert {(r.project, r.name, r.detail) for r in found.collect()} == {
        ("p", "c", "Suspicious AST patterns detected: os.system call in c.py"), ("p", "d", "Suspicious AST patterns detected: os.system call in e.py")
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_direct_packages_without_a_key(spark):
    packages = spark.createDataFrame(
        [("p", "a", False), ("p", "b", False), ("p", None, False), ("q", "a", True), ("q", "b", False), ("q", None, False), (None, "a", False), ("r", "a", False), ("r", "b", False), ("r", None, False), ("p", "a", False), ("s", "a", None), ("s", "b", None), ("q", "c", None)],
        "project string, name string, direct boolean",
    )
    edges = spark.createDataFrame([("p", "a", "b"), ("q", "a", "b"), (None, "a", "a")], "project string, src string, dst string")
    declared = spark.createDataFrame([("r", "b")], "project string, name string")
    got = sorted((str(r.project), str(r.name), str(r.direct)) for r in manifests.mark_direct(packages, edges, declared).collect())
    assert got == sorted((p, n, str(d)) for p, n, d in [
        ("p", "a", True), ("p", "a", True), ("p", "b", False), ("p", "None", True), ("q", "a", True), ("q", "b", False), ("q", "None", False),
        ("None", "a", True), ("r", "a", False), ("r", "b", True), ("r", "None", False), ("s", "a", True), ("s", "b", True), ("q", "c", None),
    ])


def test_body_texts_are_not_moved_for_line_numbers(spark):
    df = spark.createDataFrame([("A", "--- a/n\n+++ b/n\n@@ -1 +1 @@\n-old\n+new\n")], "advisory string, content string")
    changes = diff.diff_changes(diff.diff_lines(df, "advisory"), "advisory").select("side", "lineno")
    assert {tuple(r) for r in changes.collect()} == {("removed", 1), ("added", 1)}
    node, windows = changes._jdf.queryExecution().optimizedPlan(), 0
    while node.children().nonEmpty():
        if node.nodeName() == "Window":
            windows += 1
            assert "line#" not in node.output().mkString(" "), node.toString()
        node = node.children().head()
    assert windows


def test_requirement_files_are_cut_once(spark, monkeypatch):
    cut = []
    real = requirements.requirement_lines
    monkeypatch.setattr(requirements, "requirement_lines", lambda files: cut.append(files) or real(files))
    files = spark.createDataFrame([("a.txt", "x==1\n-r b.txt\n"), ("b.txt", "y==2\n-r c.txt\n"), ("c.txt", "z\n"), ("d.txt", "w\n"), ("e.txt", None)], "path string, content string")
    packages, missing = requirements.requirement_packages(spark.createDataFrame([("p", "a.txt"), ("p", "e.txt")], "project string, path string"), files)
    assert sorted(r.name for r in packages.collect()) == ["x", "y", "z"] and missing.count() == 0
    assert sorted(r.path for df in cut for r in df.select("path").collect()) == ["a.txt", "b.txt", "c.txt", "e.txt"]


def test_tree_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.sql("SELECT 1 AS n_nationkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.sql("SELECT 1L AS s_suppkey, 1 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT 1L AS p_partkey, 1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(400).selectExpr("id AS c_custkey", "1 AS c_nationkey", "'c' AS c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    tasks = []
    real = folders.write_tree

    def write(files, root):
        tasks.append(files.where("path LIKE '%__init__.py'").select(F.spark_partition_id()).distinct().count())
        real(files, root)

    monkeypatch.setattr(folders, "write_tree", write)
    assert folders.folder_scan(spark, str(tmp_path)).where("what = 'source'").count() == 200
    assert tasks[0] > 1


def test_versions_are_parsed_where_an_advisory_names_the_package(spark):
    events = [[{"introduced": "1"}, {"fixed": "2.0"}, {"introduced": "3"}, {"last_affected": "3.5"}]]
    entry = ("pypi", "a", ["9!bad~", "7"], [{"type": "ECOSYSTEM", "events": e} for e in events], ["s", "r", "s"])
    schema = "id string, withdrawn string, affected array<struct<ecosystem:string,name:string,versions:array<string>,ranges:array<struct<type:string,events:array<map<string,string>>>>,symbols:array<string>>>"
    open_end = ("pypi", "a", [], [{"type": None, "events": [{"introduced": "8"}, {"fixed": "x"}]}], [])
    index = matching.advisory_index(spark.createDataFrame([("one", None, [entry]), ("two", None, [entry, open_end]), ("gone", "2024", [entry])], schema))
    texts = ["0.9", "1", "1.9", "2.0", "2.5", "3", "3.5", "3.5.1", "7", "8", "9!bad~", None]
    installed = spark.createDataFrame([("PyPI", n, v) for n in ("a", "b", None) for v in texts], "ecosystem string, name string, version string")
    hits = matching.match_versions(installed, materialize(index, "index"), keyed_fixes=True)
    got = {(r.name, r.vuln_id, r.version, "|".join(r.fixed_versions), "|".join(r.symbols)) for r in hits.collect()}
    inside = [("1", "2.0"), ("1.9", "2.0"), ("3", ""), ("3.5", ""), ("7", "")]
    assert got == {("a", a, v, f, "r|s") for a in ("one", "two") for v, f in inside} | {("a", "two", "8", "", "")}
    assert all([f.version for f in r.fixes] == r.fixed_versions for r in hits.collect())
    # The key is made above the join that drops the names without an advisory, never below it.
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("LeftSemi")[1]
    assert "regexp_replace" in plan and "regexp_replace" not in below


def test_advisories_without_a_cve_are_not_joined(spark):
    advisories = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", ["cve-1", "CVE-2"]), ("c", ["CVE-9"]), ("CVE-1", [None]), ("d", ["CVE-7"])], "id string, aliases array<string>")
    epss = spark.createDataFrame([("CVE-1", 0.1, 0.2), ("CVE-2", None, 0.4), (None, 0.5, 0.5)], "cve string, score double, percentile double")
    kev = spark.createDataFrame([("CVE-1", "2024"), (None, "2023")], "cve string, date_added string")
    found = enrich(advisories, epss, kev)
    assert {r.vuln_id: tuple(r)[1:] for r in found.collect()} == {
        "a": (None, None, False, None, "none"), "b": (None, None, False, None, "none"), "c": (None, 0.4, True, "2024", "seed"),
        "CVE-1": (0.1, 0.2, True, "2024", "seed"), "d": (None, None, False, None, "none"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isnotnull(cve" in plan.split("Join LeftOuter")[-1]


def test_a_record_is_moved_once_on_its_way_into_the_store(spark, tmp_path):
    schema = "path string, ix int, id string, aliases array<string>, affected array<struct<ecosystem:string,name:string>>"
    rows = [(f"f{n}", 0, f"A-{i:03}", [f"v{n}"], [("PyPI", "x"), ("PyPI", "x"), ("pypi", "x")]) for n in range(3) for i in range(50)]
    parsed = materialize(spark.createDataFrame(rows, schema), "parsed")
    latest = sorted_latest_records(parsed, "path", parts=4)
    assert latest._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    parts = [[r.id for r in p] for p in latest.rdd.glom().collect()]
    assert len([p for p in parts if p]) > 1 and [i for p in parts for i in p] == sorted({r[2] for r in rows})
    assert {tuple(r.aliases) for r in latest.collect()} == {("v2",)}
    named = affected_names(latest)
    assert "Exchange hashpartitioning" not in named._jdf.queryExecution().executedPlan().toString()
    assert named.count() == 100 and named.distinct().count() == 100


def test_a_bucket_of_mined_symbols_is_few_files(spark, tmp_path):
    osv = tmp_path / "mirror" / "osv"
    spark.range(600).selectExpr("""'{"id":"A-' || id || '","affected":[{"package":{"ecosystem":"PyPI","name":"x"}}]}' AS value""").write.text(str(osv))
    (osv / "bad.txt").write_text("{not json\n")
    store = AdvisoryStore(spark, str(tmp_path / "store"))
    assert store.sync(str(tmp_path / "mirror"), lines=True)["skipped_files"] == 1
    mined = spark.range(600).selectExpr("'A-' || id AS advisory", "'m.f' AS qualified", "'f' AS short").repartition(16)
    store.add_mined(mined, "patch")
    store.add_mined(mined, "patch")
    assert store.table("mined").count() == 1200
    assert len(store.table("mined").inputFiles()) <= 64 * 2


def test_a_drop_is_moved_without_what_matching_does_not_read(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(feeds, "latest_records", lambda df, *order: kept.append(df.columns) or latest_records(df, *order))
    installed = spark.createDataFrame([("p", "PyPI", "x", "1.0"), ("p", "PyPI", "y", "1.0")], "project string, ecosystem string, name string, version string")
    live = feeds.LiveHits(installed, str(tmp_path / "live"))
    text = '{"id":"A","summary":"s","affected":[{"package":{"ecosystem":"PyPI","name":"x"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"}]}]}]}'
    live.apply(spark.createDataFrame([(text, "f")], "content string, path string"), 0)
    assert [tuple(r) for r in live.hits().select("name", "vuln_id").collect()] == [("x", "A")]
    assert kept == [["path", "line", "ix", "id", "withdrawn", "affected"]]
