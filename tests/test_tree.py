"""Listing in rounds, and that only chosen files are opened."""

from __future__ import annotations

import json

import pytest

from plumbline.plans.project import read_code, scan_target
from plumbline.sources import tree
from plumbline.sources.manifests import read_project_files


@pytest.fixture
def deep(tmp_path):
    for i in range(7):
        at = tmp_path / f"d{i}" / "_x" / ".y"
        at.mkdir(parents=True)
        for j in range(3):
            (at / f"f{j}.py").write_text(f"{i}{j}")
    (tmp_path / "top.py").write_text("top")
    return tmp_path


def test_rounds_find_the_same_files(spark, deep, monkeypatch):
    whole = {(r.path, r.size, r.error) for r in tree.list_tree(spark, str(deep)).collect()}
    assert len(whole) == 22 and ("d3/_x/.y/f1.py", 2, None) in whole
    monkeypatch.setattr(tree, "FIRST_ENTRIES", 1)
    monkeypatch.setattr(tree, "ROUND_ENTRIES", 1)
    monkeypatch.setattr(tree, "FOLDERS_PER_TASK", 2)
    rows = tree.list_tree(spark, str(deep)).collect()
    assert len(rows) == 22 and {(r.path, r.size, r.error) for r in rows} == whole


def test_empty_and_missing_roots(spark, tmp_path):
    assert tree.list_tree(spark, str(tmp_path)).count() == 0
    assert tree.read_tree(spark, str(tmp_path)).count() == 0
    assert tree.list_tree(spark, str(tmp_path / "gone")).count() == 0


def test_only_chosen_files_are_opened(spark, store, tmp_path):
    """A link to the memory of the process fails when it is read; those that belong to nothing are not read."""
    (tmp_path / "requirements.txt").write_text("-r more/a.list\nwebby==2.1\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.list").write_text("-r b.list\none==1\n")
    (tmp_path / "more" / "b.list").write_text("-r ../requirements.txt\n-r none.txt\ntwo==2\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "__init__.py").write_text("import one\n")
    (tmp_path / "src" / "gone.py").symlink_to("/proc/self/mem")
    (tmp_path / "node_modules").mkdir()
    for unrelated in ("notes.txt", "more/requirements.txt", "node_modules/gone.py"):
        (tmp_path / unrelated).symlink_to("/proc/self/mem")
    files = read_project_files(spark, str(tmp_path), True).collect()
    assert sorted((r.path[len(str(tmp_path)) + 1 :], r.top) for r in files) == [("more/a.list", False), ("more/b.list", False), ("requirements.txt", True)]
    own, installed = read_code(spark, str(tmp_path), str(tmp_path), False)
    assert {(r.path, r.error is None) for r in own.collect()} == {("src/__init__.py", True), ("src/gone.py", False)}
    assert installed.count() == 0
    done = scan_target(spark, store, str(tmp_path))
    assert {r.name for r in done.result.packages.collect()} == {"webby", "one", "two"}
    warnings = json.loads(done.manifests().first().manifest)["warnings"]
    assert any("missing file: none.txt" in w for w in warnings) and any("gone.py" in w for w in warnings)
    assert not any("notes" in w or "node_modules" in w for w in warnings)


def test_named_manifest_and_what_it_includes(spark, tmp_path):
    (tmp_path / "deps.req").write_text("-r other.txt\na==1\n")
    (tmp_path / "other.txt").write_text("b==2\n")
    (tmp_path / "requirements.txt").write_text("c==3\n")
    files = read_project_files(spark, str(tmp_path / "deps.req"), False).collect()
    assert {(r.path.rpartition("/")[2], r.top, r.kind) for r in files} == {("deps.req", True, "requirements.txt"), ("other.txt", False, None)}
