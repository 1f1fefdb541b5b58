import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.fixed_values import POPULAR_NAMES, TYPOSQUAT_ALLOWED
from plumbline.operators import callgraph, diff, mining, supply_chain
from plumbline.operators.graph import closure, paths, walk
from plumbline.operators.traces import fold_calls, load_trace, trace_documents
from plumbline.sources import requirements
from plumbline.sources.manifests import dependency_edges, mark_direct, merge_packages, most_trusted, resolve
from plumbline.sources.pyfacts import file_facts, source_facts
from plumbline.streaming.feeds import match_drops, read_advisory_drops, stream_calls


def test_closure_against_brute_force(spark):
    rng = random.Random(3)
    edges = {(p, str(rng.randrange(30)), str(rng.randrange(30))) for p in "ab" for _ in range(45)}
    seeds = {("a", "1"), ("a", "2"), ("b", "3")}
    best = {(p, n): [n] for p, n in seeds}
    while True:
        found = {}
        for p, s, d in edges:
            if (p, s) in best and (p, d) not in best:
                path = best[p, s] + [d]
                found[p, d] = min(found.get((p, d), path), path)
        if not found:
            break
        best.update(found)
    e = spark.createDataFrame(sorted(edges), "project string, src string, dst string")
    s = spark.createDataFrame(sorted(seeds), "project string, node string")
    got = {(r.project, r.node): r.path for r in closure(e, s, ["project"], with_path=True).collect()}
    assert got == best


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_typosquats_against_brute_force(spark):
    rng = random.Random(5)
    names = {"numpi", "six2", "pip", "requests", "typing-extensions", "zzzzzzzzzz", "djang", "x" * 80}
    for name in rng.sample(POPULAR_NAMES, 25):
        for _ in range(4):
            t = list(name)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["", "q", "e"])
            names.add("".join(t))
    want = {}
    for n in names - set(POPULAR_NAMES) - set(TYPOSQUAT_ALLOWED):
        near = [(edit_distance(n, p), p) for p in POPULAR_NAMES if abs(len(n) - len(p)) <= 2]
        near = [x for x in near if 1 <= x[0] <= 2]
        if len(n) >= 4 and near:
            want[n] = min(near)
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {r.name: (r.distance, r.nearest) for r in supply_chain.similar_names(df, supply_chain.popular_names(spark)).collect()}
    assert got == want and len(want) > 20


def reach(spark, sources, library=False):
    files = spark.createDataFrame([("p", k, v) for k, v in sources.items()], "project string, path string, content string")
    graph = callgraph.call_graph(source_facts(files, "project", "path"), files)
    return {(r.dist, r.symbol): r.path for r in callgraph.reached_symbols(*graph, library=library).collect()}


def test_call_graph_rules(spark):
    got = reach(spark, {
        "pkg/__init__.py": "from .core import start\nstart()\n",
        "pkg/core.py": "import yaml as y\nimport os.path\n\ndef start():\n    C().run()\n    def inner():\n        y.load('x')\n    f = y.dump\n    f()\n    os.path.join('a')\n\nclass C:\n    def run(self):\n        self.go()\n    def go(self):\n        y.safe_load(1)\n\nC.go(None)\n",
        "redefined.py": "import lib\ndef f():\n    lib.old()\ndef f():\n    lib.new()\nf()\n",
        "dyn.py": "m = __import__('cv2.x')\n",
        "dead.py": "from lib import unused\ndef g():\n    unused()\n",
        "bad.py": "def (:\n",
    })
    assert set(got) == {("pyyaml", "dump"), ("lib", "new"), ("opencv-python", "<module>")}
    assert got["pyyaml", "dump"] == ["pkg:<toplevel>", "pkg.core.start", "pyyaml.dump"]
    assert ("lib", "unused") in reach(spark, {"dead.py": "from lib import unused\ndef g():\n    unused()\n"}, library=True)


PATCH = """prose before
diff --git a/src/m.py b/src/m.py
--- a/src/m.py
+++ b/src/m.py
@@ -1,3 +1,4 @@ class Box:
 keep
-old
+new
+more
\\ No newline at end of file
@@ -20 +21,2 @@ def helper(a):
+tail
diff --git a/gone.txt b/gone.txt
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_paths_are_the_first_of_the_shortest(spark):
    """Long chains, ties between paths and cycles against a plain search."""
    import random

    rng = random.Random(6)
    edges = {("p", f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(150)} | {("q", f"c{i:03}", f"c{i + 1:03}") for i in range(40)}
    seeds = [("p", "n00"), ("p", "n07"), ("q", "c000"), ("q", "lone")]
    want, level = {s: [s[1]] for s in seeds}, {s: [s[1]] for s in seeds}
    while level:
        found = {}
        for (project, node), path in level.items():
            for p, a, b in edges:
                if (p, a) == (project, node) and (p, b) not in want:
                    found[p, b] = min(found.get((p, b), ["~"]), [*path, b])
        want.update(found)
        level = found
    e, s = spark.createDataFrame(sorted(edges), "project string, src string, dst string"), spark.createDataFrame(seeds, "project string, node string")
    got = closure(e, s, ["project"], with_path=True).collect()
    assert {(r.project, r.node): list(r.path) for r in got} == want and all(r.depth == len(r.path) - 1 for r in got)
    walked = walk(e, s, ["project"], pointers=True)
    some = paths(walked, walked.where("node in ('c033', 'c001', 'n00')"), ["project"])
    assert {r.node: len(r.path) for r in some.collect()} == {"c033": 34, "c001": 2, "n00": 1}


def test_edges_are_not_moved_again(spark):
    from plumbline.session import bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("cast(id % 3 as string) as project", "cast(id as string) as src", "cast(id + 1 as string) as dst")
        edges = bucketed(rows, ["project", "src"], "edges")
        joined = spark.range(9).selectExpr("cast(id % 3 as string) as project", "cast(id as string) as src").repartition(3).join(edges, ["project", "src"])
        assert joined.count() == 9
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(project") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diff(spark):
    df = spark.createDataFrame([("A", PATCH), ("B", "@@ -1 +1 @@\n+no file\n"), ("C", "")], "advisory string, content string")
    lines = diff.diff_lines(df, "advisory")
    changes = [(r.file_ix, r.side, r.lineno, r.text) for r in diff.diff_changes(lines, "advisory").orderBy("file_ix", "hunk_ix", "lineno", "side").collect()]
    assert changes == [(1, "added", 2, "new"), (1, "removed", 2, "old"), (1, "added", 3, "more"), (1, "added", 21, "tail"), (2, "removed", 1, "x")]
    files = [(r.old_path, r.new_path, r.is_python) for r in diff.diff_files(lines, "advisory").orderBy("file_ix").collect()]
    assert files == [("src/m.py", "src/m.py", True), ("gone.txt", None, False)]
    hunks = [(r.old_count, r.new_count, r.section) for r in diff.diff_hunks(lines, "advisory").orderBy("hunk_ix").collect()]
    assert hunks == [(3, 4, " class Box:"), (1, 2, " def helper(a):"), (1, 0, "")]


def test_lines_that_look_like_file_headers(spark):
    """Hunk counts decide; beyond them, or with ``bounded=False``, such lines open a file."""
    patch = "--- a/n\n+++ b/n\n@@ -1,2 +1,2 @@\n--- old\n+++ new\n kept\n--- a/second\n+++ b/second\n@@ -5 +5,0 @@\n--- gone\n--- a/third\n+++ b/third\n@@ -1,0 +2 @@\n+++ last\n"
    df = spark.createDataFrame([("A", patch)], "advisory string, content string")
    lines = diff.diff_lines(df, "advisory")
    changes = [(r.side, r.lineno, r.text) for r in diff.diff_changes(lines, "advisory").orderBy("hunk_ix", "side").collect()]
    assert changes == [("added", 1, "++ new"), ("removed", 1, "-- old"), ("removed", 5, "-- gone"), ("added", 2, "++ last")]
    assert diff.diff_changes(diff.diff_lines(df, "advisory", bounded=False), "advisory").count() == 0


def test_mining_prefers_source(spark):
    df = spark.createDataFrame([("A", PATCH)], "advisory string, content string")
    assert {(r.qualified, r.method) for r in mining.mine_patches(df).collect()} == {("Box", "hunk-header"), ("helper", "hunk-header")}
    source = "@deco\nclass Box:\n    def a(self):\n        pass\n" + "\n" * 15 + "def helper(a):\n    return a\n"
    facts = source_facts(spark.createDataFrame([("m.py", source)], "path string, content string"), "path")
    mined = mining.mine_patches(df, facts.where("kind in ('def', 'class')"))
    assert {(r.qualified, r.short, r.method) for r in mined.collect()} == {("Box", "Box", "ast"), ("Box.a", "a", "ast"), ("helper", "helper", "ast")}


def test_mined_symbols_reach_the_index(spark, store):
    mined = spark.createDataFrame([("ADV-4", "t.py", "Env.expand", "expand", "ast"), ("NOPE", "t.py", "x", "x", "ast")], "advisory string, path string, qualified string, short string, method string")
    assert store.add_mined(mined, "t") == (1, 2) and store.add_mined(mined, "t") == (1, 2)
    assert store.mined_count() == 1
    entry = store.index().where("vuln_id = 'ADV-4'").first().entries[0]
    assert entry.symbols == ["expand"]


@pytest.mark.parametrize("text,want", [
    ("requests[security, x] >= 2.0, <3 ; python_version > '3'", ("requests", ">= 2.0, <3", ["security", "x"], "python_version > '3'", None)),
    ("A_b.C===1.0", ("a-b-c", "===1.0", [], None, "1.0")), ("a>=1,==1.5", ("a", ">=1,==1.5", [], None, "1.5")), ("a==1.*", ("a", "==1.*", [], None, None)),
    ("a==bad!", ("a", "==bad!", [], None, None)), ("git+ssh://h/r#egg=My_Egg", ("my-egg", "", [], None, None)), ("https://h/x.whl", None), ("-e .", None), ("./x", None),
    ("# c", None), ("", None), ("two words", None), ("requests (>=2)", None),
])
def test_requirement(spark, text, want):
    r = spark.range(1).select(requirements.parse_requirement(F.lit(text)).alias("r")).first().r
    assert (r and (r.canonical, r.specifier, r.extras, r.marker, r.pinned)) == want


def test_requirement_files(spark):
    files = spark.createDataFrame([
        ("d/r.txt", "a==1\n-r sub/b.txt\n-r c.txt\nz==9 \\\n  --hash=sha256:q \\\n --hash=sha256:r # note\nlast==1 \\"), ("d/sub/b.txt", "b==2\n-r ../c.txt\n-r ../r.txt\n"), ("d/c.txt", "c>=3\n-r none.txt\n"),
    ], "path string, content string")
    packages, missing = requirements.requirement_packages(spark.createDataFrame([("p", "d/r.txt")], "project string, path string"), files)
    got = [(r.name, r.version, r.confidence, r.hashes) for r in packages.orderBy("place").collect()]
    assert got == [("a", "1", "pinned", []), ("b", "2", "pinned", []), ("c", None, "constrained", []), ("z", "9", "lockfile", ["sha256:q", "sha256:r"])]
    assert [r.path for r in missing.collect()] == ["d/none.txt"]


def files_of(spark, **texts):
    return spark.createDataFrame([("p", f"p/{k.replace('__', '.')}", v, "s", True) for k, v in texts.items()], "project string, path string, content string, sha256 string, top boolean")


def test_best_manifest_wins_and_broken_ones_warn(spark):
    got = resolve(files_of(spark, requirements__txt="a==1\n", Pipfile__lock='{"default": {"B": {"version": "==2"}}, "develop": {"c": "bad"}}'))
    assert {(r.name, r.version, r.direct) for r in got.packages.collect()} == {("b", "2", True), ("c", None, False)}
    broken = resolve(files_of(spark, requirements__txt="a==1\n", poetry__lock="= nope"))
    assert broken.packages.isEmpty() and [r.message for r in broken.warnings.collect()] == ["could not parse poetry.lock"]


def test_roots_fall_back_to_unneeded_packages(spark):
    packages = spark.createDataFrame([("p", n, False) for n in "abc"] + [("q", "x", False), ("q", "y", False)], "project string, name string, direct boolean")
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("q", "x", "y"), ("q", "y", "x")], "project string, src string, dst string")
    declared = spark.createDataFrame([], "project string, name string")
    assert {(r.project, r.name) for r in mark_direct(packages, edges, declared).where("direct").collect()} == {("p", "a")}
    named = spark.createDataFrame([("p", "b"), ("p", "ghost")], "project string, name string")
    assert {(r.project, r.name) for r in mark_direct(packages, edges, named).where("direct").collect()} == {("p", "b")}


def test_merge_and_authority(spark):
    rows = spark.createDataFrame([("p", "a", None, 1), ("p", "a", "2", 2), ("p", "a", "3", 3), ("p", "b", None, 4)], "project string, name string, version string, load_order int")
    assert {(r.name, r.version) for r in merge_packages(rows).collect()} == {("a", "2"), ("b", None)}
    ranked = spark.createDataFrame([("p", 20), ("p", 40), ("q", 20)], "project string, rank int")
    assert {tuple(r) for r in most_trusted(ranked).select("project", "rank").collect()} == {("p", 40), ("q", 20)}


def test_traces(spark):
    calls = fold_calls(spark.createDataFrame([("call", "m", "f"), ("call", "m", "f"), ("call", "m", "<lambda>"), ("call", "m", "<module>"), ("return", "m", "g"), ("call", "", "h")], "event string, module string, func string"))
    assert [(r.module, r.functions) for r in trace_documents(calls).collect()] == [("m", ["<module>", "f"])]
    raw = spark.createDataFrame([('{"m": ["f", "g"], "n": []}',), ("[1]",), ("nope",)], "content string")
    assert {(r.module, r.func) for r in load_trace(raw).collect()} == {("m", "f"), ("m", "g")}


def test_streams(spark, tmp_path):
    events = tmp_path / "events"
    spark.sql("SELECT 'call' AS event, 'm' AS module, concat('f', id % 3) AS func, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(20)").write.parquet(str(events))
    stream = spark.readStream.schema("event string, module string, func string, ts timestamp").parquet(str(events))
    q = stream_calls(stream).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.func for r in spark.sql("SELECT func FROM calls").collect()) == ["f0", "f1", "f2"]

    drops = tmp_path / "drops"
    drops.mkdir()
    adv = {"id": "N-1", "affected": [{"package": {"ecosystem": "PyPI", "name": "a"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}
    (drops / "n.json").write_text(json.dumps(adv))
    installed = spark.createDataFrame([("p", "pypi", "a", "1"), ("q", "pypi", "a", "2")], "project string, ecosystem string, name string, version string")
    seen = []
    q = match_drops(read_advisory_drops(spark, str(drops)), installed, lambda hits, n: seen.extend(hits.collect()), str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.project, r.vuln_id) for r in seen] == [("p", "N-1")]


def test_skewed_package_keeps_every_row(spark, store):
    """A package that a third of all installs name."""
    from plumbline.operators import matching

    installs = spark.range(3000).select(
        F.col("id").cast("string").alias("project"), F.lit("PyPI").alias("ecosystem"),
        F.when(F.col("id") % 3 == 0, "yam-lib").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("name"), F.lit("5.3").alias("version"),
    )
    assert matching.attach_hits(installs, matching.match_versions(installs, store.index())).count() == 1000


def test_calls_carry_the_last_binding_of_their_file():
    """No join has to find out what a name means inside one file."""
    facts = file_facts("import a.b as x\nfrom ..c import y\nfrom . import z\nif 1:\n    import q as y\nx.f()\ny()\nz.g()\nfree()\nimport last as x\n")
    calls = {(f.get("base"), f["name"]): (f.get("level"), f.get("bind_base"), f.get("bind_name")) for f in facts if f["kind"] == "call"}
    assert calls == {("x", "f"): (0, "last", None), (None, "y"): (2, "c", "y"), ("z", "g"): (1, None, "z"), (None, "free"): (None, None, None)}


def test_dependency_edges_are_moved_once(spark):
    rows = [("p", "a", ["b", "b", "x"]), ("p", "b", ["a"]), ("p", "a", ["b"]), ("q", "b", ["a", "b"]), (None, "a", ["a"]), ("q", None, [None])]
    packages = spark.createDataFrame(rows, "project string, name string, depends_on array<string>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dependency_edges(packages)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, found.collect())) == [("p", "a", "b"), ("p", "b", "a"), ("q", "b", "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
