"""OSV advisories, EPSS scores and the KEV catalogue as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cvss
from plumbline.functions.identity import feed_name
from plumbline.sources.files import path_exists, read_whole_files

OSV_RECORD = """
    id STRING, aliases ARRAY<STRING>, summary STRING, details STRING,
    published STRING, modified STRING, withdrawn STRING,
    severity ARRAY<STRUCT<type: STRING, score: STRING>>,
    affected ARRAY<STRUCT<
        package: STRUCT<ecosystem: STRING, name: STRING>,
        ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<MAP<STRING, STRING>>>>,
        versions: ARRAY<STRING>,
        database_specific: STRUCT<affected_functions: ARRAY<STRING>, symbols: ARRAY<STRING>>>>,
    references ARRAY<STRUCT<type: STRING, url: STRING>>,
    database_specific STRUCT<cvss: STRUCT<score: DOUBLE, version: STRING, vectorString: STRING>>
"""


def _or_empty(items: Column, ddl: str) -> Column:
    return F.coalesce(items, F.array().cast(ddl))


def _severity(raw: Column) -> Column:
    def entry(version: Column, vector: Column, score: Column) -> Column:
        return F.struct(
            version.alias("version"), vector.alias("vector"), score.alias("base_score")
        )

    usable = F.filter(
        _or_empty(raw["severity"], "array<struct<type:string,score:string>>"),
        lambda s: (s["type"].startswith("CVSS_V3") & s["score"].startswith("CVSS"))
        | s["type"].startswith("CVSS_V4"),
    )
    parsed = F.transform(
        usable,
        lambda s: F.when(
            s["type"].startswith("CVSS_V3"),
            entry(F.lit("3.1"), s["score"], F.coalesce(cvss.base_score(s["score"]), F.lit(0.0))),
        ).otherwise(entry(F.lit("4.0"), s["score"], F.lit(0.0))),
    )
    plain = raw["database_specific"]["cvss"]
    fallback = F.when(
        plain["score"].isNotNull(),
        F.array(
            entry(F.coalesce(plain["version"], F.lit("3.1")), plain["vectorString"], plain["score"])
        ),
    ).otherwise(F.array().cast("array<struct<version:string,vector:string,base_score:double>>"))
    return F.when(F.size(usable) > 0, parsed).otherwise(fallback)


def _affected(raw: Column) -> Column:
    def first_filled(a: Column, b: Column) -> Column:
        return F.when(F.size(F.coalesce(a, F.array())) > 0, a).otherwise(
            _or_empty(b, "array<string>")
        )

    def entry(a: Column) -> Column:
        eco = F.coalesce(a["package"]["ecosystem"], F.lit(""))
        name = F.coalesce(a["package"]["name"], F.lit(""))
        extra = a["database_specific"]
        return F.struct(
            eco.alias("ecosystem"),
            feed_name(eco, name).alias("name"),
            _or_empty(
                a["ranges"], "array<struct<type:string,events:array<map<string,string>>>>"
            ).alias("ranges"),
            _or_empty(a["versions"], "array<string>").alias("versions"),
            first_filled(extra["affected_functions"], extra["symbols"]).alias("symbols"),
        )

    return F.transform(raw["affected"], entry)


# What matching reads of a record.
MATCHED = ("withdrawn", "affected")


def parse_osv(raw: DataFrame, content: str = "content", *order: str) -> DataFrame:
    """Advisory rows from JSON texts that hold one record or an array of them.

    ``order`` columns are carried along; they say which of two records with the
    same id was loaded last.
    """
    records = raw.select(
        *order, F.posexplode(F.from_json(F.col(content), f"ARRAY<STRUCT<{OSV_RECORD}>>")).alias("ix", "r")
    )
    r = F.col("r")
    fixes = F.filter(
        _or_empty(r["references"], "array<struct<type:string,url:string>>"),
        lambda ref: F.coalesce(ref["url"].contains("/commit/"), F.lit(False))
        | F.coalesce(ref["type"] == "FIX", F.lit(False)),
    )
    empty = F.lit("")
    return records.where(F.coalesce(r["id"], empty) != "").select(
        *order,
        "ix",
        r["id"].alias("id"),
        _or_empty(r["aliases"], "array<string>").alias("aliases"),
        F.coalesce(r["summary"], empty).alias("summary"),
        F.coalesce(r["details"], empty).alias("details"),
        _severity(r).alias("severity"),
        _or_empty(
            _affected(r),
            "array<struct<ecosystem:string,name:string,ranges:array<struct<type:string,"
            "events:array<map<string,string>>>>,versions:array<string>,symbols:array<string>>>",
        ).alias("affected"),
        _or_empty(r["references"], "array<struct<type:string,url:string>>").alias("references"),
        r["published"].alias("published"),
        r["modified"].alias("modified"),
        r["withdrawn"].alias("withdrawn"),
        F.transform(fixes, lambda ref: F.coalesce(ref["url"], F.lit(""))).alias("fix_commits"),
    )


def latest_records(advisories: DataFrame, *order: str) -> DataFrame:
    """One row per id: the record loaded last (an upsert)."""
    names = [c for c in advisories.columns if c not in (*order, "id")]
    return _latest(advisories, names, order)


def sorted_latest_records(advisories: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """As ``latest_records``, dealt into ranges of ids and sorted by id.

    The records are moved and sorted once: those of one id meet where their range
    is sorted anyway. ``advisories`` is read twice, so callers hand over a written one.
    """
    names = [c for c in advisories.columns if c not in (*order, "id")]
    dealt = advisories.repartitionByRange(parts, "id") if parts else advisories.repartitionByRange("id")
    return _latest(dealt.sortWithinPartitions("id"), names, order).sortWithinPartitions("id")


def _latest(advisories: DataFrame, names: list[str], order: tuple[str, ...]) -> DataFrame:
    last = advisories.groupBy("id").agg(
        F.max_by(F.struct(*names), F.struct(*order, "ix")).alias("r")
    )
    return last.select("id", *[F.col("r")[n].alias(n) for n in names if n != "ix"])


def read_osv(spark: SparkSession, folder: str, lines: bool = False, bad: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Advisories and the list of skipped (unparsable) files.

    ``lines`` reads a mirror landed as JSON lines, which splits across tasks.
    ``bad`` takes the number of unparsable texts as ``texts`` while the advisories
    are read; where it is 0, nothing has to be read again for the skipped files.
    """
    if lines:
        raw = spark.read.text(folder).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.col("value").alias("content"),
        )
        order = ["path", "block", "line"]
    else:
        raw = read_whole_files(spark, folder, "*.json")
        order = ["path"]
    good = F.try_parse_json(F.col("content")).isNotNull()
    skipped = raw.where(~good).select("path").distinct()
    if bad:
        judged = raw.withColumn("good", good)
        return parse_osv(judged.observe(bad, F.count_if(~F.col("good")).alias("texts")).where("good"), "content", *order), skipped
    return parse_osv(raw.where(good), "content", *order), skipped


def parse_epss(rows: DataFrame, *order: str) -> DataFrame:
    """``cve, score, percentile`` from text columns ``cve, epss, percentile``.

    Rows with a bad number are skipped, blanks count as 0, the last row of a
    CVE wins.
    """

    def number(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("0")).try_cast("double")

    parsed = rows.select(
        F.upper("cve").alias("cve"),
        number("epss").alias("score"),
        number("percentile").alias("percentile"),
        *order,
    ).where((F.col("cve") != "") & F.col("score").isNotNull() & F.col("percentile").isNotNull())
    last = parsed.groupBy("cve").agg(
        F.max_by(F.struct("score", "percentile"), F.struct(*order)).alias("e")
    )
    return last.select("cve", "e.score", "e.percentile")


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """EPSS feed; gzip is read as is. A missing file is an empty feed."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "cve string, score double, percentile double")
    rows = spark.read.option("comment", "#").csv(path, header=True)
    have = {c.lower() for c in rows.columns}
    absent = [F.lit("").alias(c) for c in ("cve", "epss", "percentile") if c not in have]
    rows = rows.select(
        *[F.col(c).alias(c.lower()) for c in rows.columns],
        *absent,
        F.monotonically_increasing_id().alias("line"),
    )
    return parse_epss(rows, "line")


def parse_kev(raw: DataFrame, content: str = "content", *order: str) -> DataFrame:
    """``cve, date_added`` from KEV catalogue texts; a corrupt text gives no rows."""
    schema = "vulnerabilities ARRAY<STRUCT<cveID: STRING, dateAdded: STRING>>"
    entries = raw.select(
        *order,
        F.posexplode(F.from_json(F.col(content), schema)["vulnerabilities"]).alias("ix", "e"),
    ).where(F.coalesce(F.col("e.cveID"), F.lit("")) != "")
    return entries.groupBy(F.upper("e.cveID").alias("cve")).agg(
        F.max_by(F.col("e.dateAdded"), F.struct(*order, "ix")).alias("date_added")
    )


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], "cve string, date_added string")
    return parse_kev(read_whole_files(spark, path), "content", "path")
