"""The local advisory store: versioned parquet tables in one folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import matching, mining
from plumbline.operators.enrichment import enrich
from plumbline.plans.digest import parallel_digest, snapshot_hash
from plumbline.session import materialize, materialize_counted, parts_for
from plumbline.sources import advisories as feeds
from plumbline.snapshots import Change, Snapshots, Version, bucket_of, buckets_of
from plumbline.sources.files import is_directory, path_exists, read_whole_files
from plumbline.sources.pyfacts import source_facts
from plumbline.sources.tree import read_tree

MINED = "vuln_id string, ecosystem string, name string, symbol string, qualified string, source string"
# Names that a lookup hands to the scan as a filter; a longer list is joined.
LISTED = 1000
# Records that one task sorts.
SORTED_ROWS = 1 << 15


class AdvisoryStore:
    """Advisories, EPSS, KEV, mined symbols and snapshot facts.

    Every change is one commit of ``Snapshots``: a sync or a mining run that dies
    leaves the version before it in force. ``version`` binds a store to one version,
    whatever is published later; ``pinned`` binds it to the last one.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.number = version
        self.snapshots = Snapshots(spark, path)

    def pinned(self) -> AdvisoryStore:
        """The same store, bound to the version that is the last one now."""
        return AdvisoryStore(self.spark, self.path, self._version().number)

    def _version(self) -> Version:
        return self.snapshots.version(self.number)

    def table(self, name: str) -> DataFrame:
        return self.snapshots.read(self._version(), name)

    def _change(self) -> Change:
        if self.number is not None:
            raise ValueError("this store is bound to one version; change the store itself")
        return self.snapshots.change()

    # -- ingestion ---------------------------------------------------------
    def sync(self, folder: str, label: str = "seed", lines: bool = False) -> dict:
        """Rebuild every table from a landed mirror: ``osv/``, ``epss.csv``
        (or ``epss.csv.gz``) and ``kev.json``. Mined symbols start empty."""
        osv = f"{folder}/osv"
        order = ["path", "block", "line"] if lines else ["path"]
        if is_directory(self.spark, osv):
            bad = Observation()
            parsed, skipped = feeds.read_osv(self.spark, osv, lines, bad)
            parsed, n_parsed = materialize_counted(parsed, "osv")
            n_skipped = skipped.count() if bad.get["texts"] else 0
        else:
            raw = self.spark.createDataFrame([], "path string, content string")
            parsed, n_parsed, n_skipped, order = feeds.parse_osv(raw, "content", "path"), 0, 0, ["path"]
        change = self._change()
        parts = parts_for(self.spark, n_parsed, SORTED_ROWS)
        # Sorted and with Bloom filters, so that lookups of ids and names skip what does not hold them.
        latest = feeds.sorted_latest_records(parsed, *order, parts=parts)
        kept = change.put("advisories", latest, **{"parquet.bloom.filter.enabled#id": "true"})
        names = affected_names(kept)
        names = (names.repartitionByRange(parts, "eco", "name") if parts else names.repartitionByRange("eco", "name")).sortWithinPartitions("eco", "name")
        change.put("names", names, **{"parquet.bloom.filter.enabled#name": "true"})
        gz = f"{folder}/epss.csv.gz"
        epss = gz if path_exists(self.spark, gz) else f"{folder}/epss.csv"
        epss = change.put("epss", feeds.read_epss(self.spark, epss))
        kev = change.put("kev", feeds.read_kev(self.spark, f"{folder}/kev.json"))
        change.put_buckets("mined", self.spark.createDataFrame([], MINED), "vuln_id")
        full = parallel_digest(kept, *kept.columns).first().digest
        info = {
            "source": label,
            "synced_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "content_hash": snapshot_hash(parsed),
            "full_hash": "sha256-bag:" + full[:32],
            "record_count": n_parsed,
            "epss_count": epss.count(),
            "kev_count": kev.count(),
        }
        if n_skipped:
            info["skipped_files"] = n_skipped
        change.publish({k: str(v) for k, v in info.items()})
        return info

    def mine(self, patches: str, source_root: str | None = None, source: str = "seed-patch") -> tuple[int, int]:
        """Mine ``<advisory>.patch|diff`` files; (advisories, symbols) stored."""
        files = read_whole_files(self.spark, patches, "*.{patch,diff}")
        name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        known = files.withColumn("advisory", name).join(
            self.advisories.select(F.col("id").alias("advisory")), "advisory", "left_semi"
        )
        spans = None
        if source_root:
            spans = source_facts(read_tree(self.spark, source_root), "path").where("kind in ('def', 'class')")
        mined = mining.mine_patches(known.withColumnRenamed("path", "patch"), spans, ("advisory", "patch"))
        return self.add_mined(mined, source)

    def add_mined(self, mined: DataFrame, source: str) -> tuple[int, int]:
        """Store mined symbols of known advisories, replacing earlier ones.

        Only the buckets of these advisories are read and written.
        """
        change = self._change()
        fresh = materialize(mining.mined_symbols(mined, self.affected_packages(), source), "mined")
        touched = buckets_of(fresh, "vuln_id")
        stored = self.snapshots.read(change.base, "mined", touched)
        # Dealt by bucket, so that a bucket is a few files and not one of every task.
        dealt = mining.replace_mined(stored, fresh).repartition(bucket_of("vuln_id"), F.pmod(F.xxhash64("vuln_id", "name", "symbol", "qualified"), F.lit(8)))
        change.put_buckets("mined", dealt, "vuln_id", touched)
        change.publish()
        counts = fresh.agg(F.count_distinct("vuln_id").alias("a"), F.count("*").alias("s")).first()
        return counts.a, counts.s

    # -- queries -----------------------------------------------------------
    @property
    def advisories(self) -> DataFrame:
        return self.table("advisories")

    def affected_packages(self) -> DataFrame:
        """``vuln_id, ecosystem, name`` of every advisory."""
        return self.table("names").select("vuln_id", "ecosystem", "name").distinct()

    def index(self, any_range_type: bool = True) -> DataFrame:
        """Matching index with mined symbols folded in."""
        return matching.merge_mined_symbols(
            matching.advisory_index(self.advisories, any_range_type), self.table("mined")
        )

    def lookup(self, packages: DataFrame) -> DataFrame:
        """Advisories that name any of ``packages`` (ecosystem, name).

        Up to ``LISTED`` names and ids go to the scans as filters, which skip the
        files and row groups that hold none of them; more are joined.
        """
        wanted = packages.select(F.lower("ecosystem").alias("eco"), "name").distinct()
        named = _among(self.table("names"), "name", wanted.select("name")).join(wanted, ["eco", "name"], "left_semi")
        ids = named.select(F.col("vuln_id").alias("id")).distinct()
        return _among(self.advisories, "id", ids).join(ids, "id", "left_semi")

    def enrichment(self) -> DataFrame:
        return enrich(self.advisories, self.table("epss"), self.table("kev"), self.info().get("source", "seed"))

    def has(self, vuln_id: str) -> bool:
        return not self.advisories.where(F.col("id") == vuln_id).select("id").isEmpty()

    def is_empty(self) -> bool:
        return self._version().number == 0 or self.advisories.isEmpty()

    def mined_count(self) -> int:
        return self.table("mined").agg(F.count_distinct("vuln_id")).first()[0]

    def info(self) -> dict:
        """Snapshot facts, which ``sync`` notes in its commit."""
        facts = dict(self._version().notes)
        for key in ("record_count", "epss_count", "kev_count"):
            if str(facts.get(key, "")).isdigit():
                facts[key] = int(facts[key])
        return facts


def affected_names(advisories: DataFrame) -> DataFrame:
    """``eco, name, ecosystem, vuln_id`` of every package an advisory names; ``advisories`` has a row for each id."""
    package = lambda a: F.struct(F.lower(a["ecosystem"]).alias("eco"), a["name"].alias("name"), a["ecosystem"].alias("ecosystem"))
    named = advisories.select(F.col("id").alias("vuln_id"), F.explode(F.array_distinct(F.transform("affected", package))).alias("a"))
    return named.select("a.eco", "a.name", "a.ecosystem", "vuln_id")


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is in ``wanted`` where the list is short; all of them otherwise."""
    listed = wanted.distinct().limit(LISTED + 1).collect()
    return rows.where(F.col(column).isin([r[0] for r in listed])) if len(listed) <= LISTED else rows
