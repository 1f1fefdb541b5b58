import json

import pytest
from pyspark.sql import functions as F

from plumbline.cli import main
from plumbline.plans.project import scan_target
from plumbline.report.document import stream, write


@pytest.fixture(scope="module")
def done(spark, store, project):
    return scan_target(spark, store, str(project))


@pytest.fixture(scope="module")
def rows(done):
    return done.result.findings.collect()


def by_vuln(rows, vid):
    return next(r for r in rows if r.vuln_id == vid)


def test_packages(done):
    packages = {r.name: r for r in done.resolution.packages.collect()}
    assert set(packages) == {"yam-lib", "webby", "tmpl", "idle", "requestss"}
    assert packages["yam-lib"].direct and not packages["tmpl"].direct and not packages["idle"].direct
    assert packages["yam-lib"].hashes == ["sha256:aa"] and packages["yam-lib"].purl == "pkg:pypi/yam-lib@5.3"


def test_direct_symbol(rows):
    r = by_vuln(rows, "ADV-1")
    assert r.symbol_hit
    assert r.call_path == ["app.main:<toplevel>", "app.main.main", "app.config.read", "yam-lib.load_all"]
    assert (r.risk.value, r.risk.band, r.fixed_versions) == (71.3, "HIGH", ["5.4"])
    assert r.imported_symbols == ["load_all"] and r.entry_paths == ["app/config.py"]


def test_cross_package_path(rows):
    r = by_vuln(rows, "ADV-2")
    assert r.deep and r.symbol_hit and r.analysis == "cross-package"
    assert r.call_path[-4:] == ["webby.get", "↘ webby internals", "webby.send", "webby.rebuild_auth"]
    assert (r.risk.value, r.risk.band) == (69.4, "HIGH")


def test_transitive_and_kev(rows):
    r = by_vuln(rows, "ADV-4")
    assert (r.status, r.kev, r.kev_date_added, r.cve) == ("reachable", True, "2024-03-03", "CVE-2020-4")
    assert not any(x.vuln_id == "ADV-3" for x in rows)


def test_supply_chain(rows):
    got = {(r.name, r.signal): r for r in rows if r.kind == "supply-chain"}
    assert set(got) == {("requestss", "typosquat"), ("webby", "malicious-behavior")}
    assert got["requestss", "typosquat"].title == "Possible typosquat: requestss ≈ requests"
    assert got["requestss", "typosquat"].risk.value == 63.0
    assert got["webby", "malicious-behavior"].detail.endswith("os.system call in hooks.py")


def test_ranking_counts_and_gate(done, rows):
    values = [r.risk.value for r in rows]
    assert values == sorted(values, reverse=True)
    c = done.result.counts().first()
    assert (c.packages, c.direct, c.vulnerabilities, c.supply_chain, c.reachable_findings) == (5, 3, 3, 2, 4)
    assert done.result.exceeds("high") and done.result.exceeds("critical")
    assert {r.band: r.findings for r in done.result.bands().collect()}["HIGH"] == sum(r.risk.band == "HIGH" for r in rows)


def test_json(done, rows):
    doc = json.loads("".join(stream(done.render("json"))))
    assert [f["risk"]["value"] for f in doc["findings"]] == [r.risk.value for r in rows]
    first = next(f for f in doc["findings"] if f["advisory"] and f["advisory"]["id"] == "ADV-1")
    assert first["advisory"]["cvss"]["base_score"] == 9.8 and first["threat_intel"]["epss"] == 0.092
    assert [n["kind"] for n in first["evidence"]["children"]] == ["version", "match", "reachability", "enrichment"]
    assert doc["manifest"]["counts"]["packages"] == 5 and doc["manifest"]["inputs"][0]["path"].endswith("poetry.lock")
    assert doc["manifest"]["target"] == rows[0].project
    assert len(json.loads("".join(stream(done.render("json", min_risk=65))))["findings"]) == sum(r.risk.value >= 65 for r in rows)


def test_sarif(done, rows):
    run = json.loads("".join(stream(done.render("sarif"))))["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(rules) == len(set(rules)) == 4 and len(run["results"]) == len(rows)
    assert {r["ruleId"] for r in run["results"]} == set(rules)
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "poetry.lock"


def test_vex(done):
    doc = json.loads("".join(stream(done.render("vex"))))
    assert {s["vulnerability"]["@id"]: s["status"] for s in doc["statements"]} == {"ADV-1": "affected", "ADV-2": "affected", "ADV-4": "affected"}
    assert doc["statements"][0]["action_statement"].startswith("Upgrade ")


def test_cyclonedx(done, rows):
    doc = json.loads("".join(stream(done.render("cyclonedx"))))
    assert {c["name"] for c in doc["components"]} == {"yam-lib", "webby", "tmpl", "idle", "requestss"}
    assert next(c for c in doc["components"] if c["name"] == "yam-lib")["hashes"] == [{"alg": "SHA-256", "content": "aa"}]
    deps = {d["ref"]: d["dependsOn"] for d in doc["dependencies"]}
    assert deps["pkg:pypi/webby"] == ["pkg:pypi/tmpl"]
    assert deps[rows[0].project] == ["pkg:pypi/requestss", "pkg:pypi/webby", "pkg:pypi/yam-lib"]
    assert len(doc["vulnerabilities"]) == 3


def test_terminal(done):
    plain = "\n".join(stream(done.render("terminal", explain=True)))
    assert "yam-lib@5.3" in plain and "REACH:DEEP" in plain and "◆ risk" in plain and "\033" not in plain
    assert "\033[1;91m" in "\n".join(stream(done.render("terminal", colour=True)))
    facts = json.loads("".join(stream(done.render("json"))))["manifest"]
    assert plain.rstrip("\n").splitlines()[-1] == f"  reproduce  {facts['tool']} scan {facts['target']} --db-snapshot {facts['db_snapshot']['content_hash']}"


def test_written_document_reads_in_name_order(done, tmp_path):
    write(done.render("json"), str(tmp_path / "out"))
    (folder,) = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert len(json.loads(text)["findings"]) == 5


def test_runtime_trace_confirms(spark, store, project, tmp_path):
    trace = tmp_path / "t.json"
    trace.write_text(json.dumps({"webby.auth": ["rebuild_auth"]}))
    r = by_vuln(scan_target(spark, store, str(project), trace_path=str(trace)).result.findings.collect(), "ADV-2")
    assert r.dynamic and r.call_path == ["RUNTIME CONFIRMED: webby.auth.rebuild_auth"] and r.analysis == "dynamic-trace"
    assert r.risk.factors["dynamic_trace_confirmed"] == 1.0


def test_manifest_file_and_unknown_reachability(spark, store, tmp_path):
    req = tmp_path / "requirements.txt"
    req.write_text("Yam.Lib==5.3 --hash=sha256:x\nwebby==2.1\ntmpl>=2\n-r missing.txt\n")
    done = scan_target(spark, store, str(req))
    rows = {r.vuln_id: r for r in done.result.findings.collect()}
    assert set(rows) == {"ADV-1", "ADV-2"} and rows["ADV-1"].status == "unknown"
    assert (rows["ADV-1"].confidence, rows["ADV-2"].confidence) == ("lockfile", "pinned")
    assert "missing.txt" in done.resolution.warnings.first().message


def test_many_projects_in_one_job(spark, store, tmp_path):
    for name, text in (("a", "yam-lib==5.3\n"), ("b", "yam-lib==5.4\nwebby==1.2\n"), ("c", "idle==1\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "requirements.txt").write_text(text)
    (tmp_path / "a" / "x.py").write_text("import yam_lib\n")
    done = scan_target(spark, store, str(tmp_path), many=True)
    got = {(r.project, r.vuln_id, r.status) for r in done.result.findings.where("kind = 'vulnerability'").collect()}
    assert got == {("a", "ADV-1", "reachable"), ("b", "ADV-2", "unknown")}


def test_cli(spark, seed, project, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert main([]) == 0
    assert main(["scan", str(tmp_path / "nowhere"), "--db", db]) == 2
    assert main(["scan", str(project), "--db", db]) == 2
    assert main(["db", "sync", "--seed", str(seed), "--db", db]) == 0
    assert main(["db", "info", "--db", db]) == 0
    assert "mined_advisories" in capsys.readouterr().out
    assert main(["scan", str(project), "--db", db, "--no-color", "--fail-on", "high"]) == 1
    assert "ADV-1" in capsys.readouterr().out
    assert main(["scan", str(project), "--db", db, "--format", "vex", "-o", str(tmp_path / "vex")]) == 0
    patches = tmp_path / "patches"
    patches.mkdir()
    (patches / "ADV-4.patch").write_text("--- a/t.py\n+++ b/t.py\n@@ -1,2 +1,2 @@ def expand(x):\n-a\n+b\n")
    (patches / "OTHER.patch").write_text("--- a/t.py\n+++ b/t.py\n@@ -1 +1 @@ def nope():\n-a\n+b\n")
    assert main(["mine", "--patches", str(patches), "--db", db]) == 0
    assert "mined 1 symbols across 1 advisories" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stop:
        main(["scan"])
    assert stop.value.code == 2
