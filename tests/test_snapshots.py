"""Commits of the store, ordinals and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.numbering import numbered
from plumbline.snapshots import BUCKETS, ChangedMeanwhile, Snapshots, bucket_of
from plumbline.store import AdvisoryStore
from plumbline.streaming.feeds import LiveHits, follow_calls, read_advisory_drops


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path))
    assert snaps.version().number == 0 and snaps.numbers() == []
    first = snaps.change()
    first.put("t", spark.range(3))
    assert snaps.numbers() == []  # written, not published
    one = first.publish({"k": 1})
    half = snaps.change()
    half.put("t", spark.range(9))
    assert ids(snaps.read(snaps.version(), "t")) == [0, 1, 2]
    two = half.publish()
    assert (two.number, two.notes) == (2, {"k": 1})
    assert ids(snaps.read(one, "t")) == [0, 1, 2] and snaps.read(snaps.version(), "t").count() == 9


def test_the_second_of_two_writers_fails(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path))
    a, b = snaps.change(), snaps.change()
    a.put("t", spark.range(1))
    b.put("t", spark.range(2))
    a.publish()
    with pytest.raises(ChangedMeanwhile):
        b.publish()
    assert snaps.read(snaps.version(), "t").count() == 1
    assert [p.name for p in (tmp_path / "commits").iterdir() if not p.name.startswith(".")] == ["000000000001"]


def test_only_touched_buckets_change(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path))
    rows = spark.range(400).select(F.concat(F.lit("v"), "id").alias("k"), F.col("id").alias("n"))
    change = snaps.change()
    change.put_buckets("t", rows, "k")
    one = change.publish()
    touched = [0, 1]
    change = snaps.change()
    kept = snaps.read(one, "t", touched).where("n % 2 = 0")
    change.put_buckets("t", kept, "k", touched)
    two = change.publish()
    want = rows.where(~bucket_of("k").isin(touched) | (F.col("n") % 2 == 0))
    assert sorted(map(tuple, snaps.read(two, "t").collect())) == sorted(map(tuple, want.collect()))
    old, new = one.tables["t"]["parts"], two.tables["t"]["parts"]
    assert {b for b in old if old[b] != new.get(b)} == {"0", "1"} and len(old) == BUCKETS
    # A bucket may become empty.
    change = snaps.change()
    change.put_buckets("t", kept.where("false"), "k", touched)
    assert "0" not in change.publish().tables["t"]["parts"]
    assert snaps.read(one, "t").count() == 400
    assert snaps.vacuum() > 0
    assert snaps.numbers() == [3]
    assert snaps.read(snaps.version(), "t").count() == rows.where(~bucket_of("k").isin(touched)).count()


def test_a_sync_that_dies_leaves_the_old_snapshot(spark, seed, tmp_path, monkeypatch):
    store = AdvisoryStore(spark, str(tmp_path / "s"))
    assert store.is_empty()
    store.sync(str(seed))
    before = store.info(), sorted(r.id for r in store.advisories.select("id").collect())
    mirror = tmp_path / "mirror" / "osv"
    mirror.mkdir(parents=True)
    (mirror / "n.json").write_text(json.dumps({"id": "NEW-1", "affected": []}))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr("plumbline.store.feeds.read_kev", dies)
        with pytest.raises(OSError):
            store.sync(str(tmp_path / "mirror"))
    assert (store.info(), sorted(r.id for r in store.advisories.select("id").collect())) == before
    pinned = store.pinned()
    store.sync(str(tmp_path / "mirror"))
    assert ids(store.advisories.select("id")) == ["NEW-1"]
    assert ids(pinned.advisories.select("id")) == before[1] and pinned.info() == before[0]
    with pytest.raises(ValueError):
        pinned.sync(str(seed))


def test_mining_again_replaces_only_its_own(spark, seed, tmp_path):
    store = AdvisoryStore(spark, str(tmp_path / "s"))
    store.sync(str(seed))

    def mine(rows, source):
        return store.add_mined(spark.createDataFrame(rows, "advisory string, qualified string, short string"), source)

    assert mine([("ADV-1", "m.f", "f"), ("ADV-2", "m.g", "g"), ("NONE", "m.h", "h")], "a") == (2, 4)
    mine([("ADV-1", "k", "k")], "b")
    mine([("ADV-1", "m.z", "z")], "a")
    got = {(r.vuln_id, r.symbol, r.source) for r in store.table("mined").collect()}
    assert got == {("ADV-1", "z", "a"), ("ADV-2", "g", "a"), ("ADV-1", "k", "b")}
    assert store.mined_count() == 2


def test_lookup_reads_few_rows(spark, tmp_path):
    mirror = tmp_path / "mirror"
    n = F.col("id").cast("string")
    text = F.format_string('{"id":"A-%s","affected":[{"package":{"ecosystem":"PyPI","name":"p%s"},"versions":["1"]}]}', n, (F.col("id") % 5000).cast("string"))
    spark.range(20000).select(text).write.text(str(mirror / "osv"))
    store = AdvisoryStore(spark, str(tmp_path / "s"))
    store.sync(str(mirror), lines=True)
    wanted = spark.createDataFrame([("pypi", "p77")], "ecosystem string, name string")
    assert ids(store.lookup(wanted).select("id")) == ["A-10077", "A-15077", "A-5077", "A-77"]
    few = store.table("names").where(F.col("name") == "p77")
    few.collect()
    assert "EqualTo(name,p77)" in few._jdf.queryExecution().executedPlan().toString()
    assert store.has("A-5") and not store.has("A-x")
    # A list too long for a filter is joined, with the same rows.
    many = spark.range(3000).select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("p"), "id").alias("name"))
    assert store.lookup(many).count() == 12000


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("t"))
    got = [(r.n, r.t, r.k) for r in numbered(rows, [F.desc("t"), F.asc("k")], "n").collect()]
    want = sorted(((r.t, r.k) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(i + 1, t, k) for i, (t, k) in enumerate(want)]
    assert numbered(rows.where("false"), [F.asc("k")], "n").count() == 0


def test_call_stream_with_restart_and_late_events(spark, tmp_path):
    landed = tmp_path / "in"
    made = "project string, event string, module string, func string, ts timestamp"

    def land(rows):
        spark.createDataFrame(rows, "project string, event string, module string, func string, ts string").selectExpr("project", "event", "module", "func", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(landed))

    def run():
        stream = spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(str(landed))
        follow_calls(stream, ["project"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("project", "func").collect()))

    land([("p", "call", "m", "f", "2024-01-02 00:00:00"), ("p", "return", "m", "x", "2024-01-02 00:00:00")])
    land([("p", "call", "m", "f", "2024-01-09 00:00:00"), ("q", "call", "m", "f", "2024-01-09 00:00:00")])
    assert run() == [("p", "f"), ("q", "f")]
    assert run() == [("p", "f"), ("q", "f")]  # nothing new
    land([("p", "call", "m", "g", "2023-01-01 00:00:00"), ("p", "call", "m", "f", "2024-01-01 00:00:00")])  # a year late
    assert run() == [("p", "f"), ("p", "g"), ("q", "f")]


def test_drops_take_hits_back(spark, tmp_path):
    landed = tmp_path / "drops"
    landed.mkdir()
    installed = spark.createDataFrame([("p", "pypi", "a", "1"), ("q", "pypi", "a", "2"), ("q", "pypi", "b", "1")], "project string, ecosystem string, name string, version string")
    live = LiveHits(installed, str(tmp_path / "live"))
    assert live.hits() is None

    def drop(name, *records):
        (landed / f"{name}.json").write_text(json.dumps(list(records)))
        live.follow(read_advisory_drops(spark, str(landed)), str(tmp_path / "c")).awaitTermination()
        return sorted((r.project, r.name, r.vuln_id) for r in live.hits().collect())

    def record(id, name, fixed, **more):
        return {"id": id, "affected": [{"package": {"ecosystem": "PyPI", "name": name}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": fixed}]}]}], **more}

    both = [("p", "a", "N-1"), ("q", "a", "N-1"), ("q", "b", "N-2")]
    assert drop("1", record("N-1", "a", "3"), record("N-2", "b", "3")) == both
    assert drop("2", record("N-1", "a", "2")) == [("p", "a", "N-1"), ("q", "b", "N-2")]
    assert drop("3", record("N-2", "b", "3", withdrawn="2024-01-01")) == [("p", "a", "N-1")]
    assert drop("4", record("N-2", "b", "3"), record("N-1", "a", "3")) == both
    number = live.snapshots.version().number
    live.apply(spark.createDataFrame([("[]", "x")], "content string, path string"), 0)  # a batch of the past
    assert live.snapshots.version().number == number
