"""Projects without packages, odd folders, unusable sources, several patches of one advisory, and workers elsewhere."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

from plumbline.operators import mining
from plumbline.plans.digest import snapshot_hash
from plumbline.plans.project import FORMATS, scan_target

REPO = Path(__file__).resolve().parent.parent


def texts(doc) -> str:
    return "".join(r.text for r in doc.orderBy("project", "part", "ord").collect())


def test_every_scanned_project_has_a_report(spark, store, tmp_path):
    (tmp_path / "bare").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "poetry.lock").write_text("[[package")
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "requirements.txt").write_text("webby==2.1\n")
    done = scan_target(spark, store, str(tmp_path), many=True)
    heads = {r.project: json.loads(r.manifest) for r in done.manifests().collect()}
    assert set(heads) == {"bare", "broken", "good"}
    assert heads["bare"]["counts"]["packages"] == 0 and heads["good"]["counts"]["packages"] == 1
    assert heads["bare"]["warnings"] == ["no supported manifest found"]
    assert "could not parse poetry.lock" in heads["broken"]["warnings"]
    for kind in FORMATS:
        projects = {r.project for r in done.render(kind).select("project").distinct().collect()}
        assert projects == {"bare", "broken", "good"}, kind


def test_a_single_target_without_manifest_is_reported(spark, store, tmp_path):
    done = scan_target(spark, store, str(tmp_path))
    assert "no supported manifest found" in texts(done.render("json"))


def test_behaviour_scan_reads_every_folder_of_a_package(spark, store, tmp_path):
    (tmp_path / "requirements.txt").write_text("webby==9.9\n")
    deep = tmp_path / "deps" / "webby" / "node_modules" / ".tox"
    deep.mkdir(parents=True)
    (deep / "evil.py").write_text("import os\nos.system('x')\n")
    (deep / "broken.py").write_text("def broken(:\n")
    (deep / "gone.py").symlink_to(tmp_path / "nowhere.py")
    done = scan_target(spark, store, str(tmp_path), [str(tmp_path / "deps")])
    found = [r.detail for r in done.result.of_kind("supply-chain").collect()]
    assert any("os.system call in evil.py" in d for d in found)
    warnings = json.loads(done.manifests().first().manifest)["warnings"]
    assert any("SyntaxError" in w and "broken.py" in w for w in warnings)


def test_patches_of_one_advisory_do_not_mix(spark):
    patch = lambda name, at: f"diff --git a/{name} b/{name}\n--- a/{name}\n+++ b/{name}\n@@ -{at},1 +{at},2 @@\n x\n+y\n"
    rows = [("ADV", "X.patch", patch("a.py", 3)), ("ADV", "X.diff", patch("b.py", 50))]
    spans = spark.createDataFrame([("a.py", 4, 4, "in_a"), ("b.py", 51, 51, "in_b")], "path string, line int, end_line int, owner string")
    mined = mining.mine_patches(spark.createDataFrame(rows, "advisory string, patch string, content string"), spans, ("advisory", "patch"))
    assert {(r.path, r.qualified) for r in mined.collect()} == {("a.py", "in_a"), ("b.py", "in_b")}


def test_snapshot_hash_has_one_definition(spark):
    rows = [(f"A{i}", str(i)) for i in range(50)]
    make = lambda r: snapshot_hash(spark.createDataFrame(r, "id string, modified string"))
    assert make(rows) == make(rows[::-1]) != make(rows[:-1])
    assert len(make(rows)) == 39


def test_workers_need_no_path(tmp_path):
    """Started elsewhere and without PYTHONPATH, the workers still find the package."""
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('rows', e.queries()['definition_spans'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in ran.stdout, ran.stderr[-2000:]
