"""Digests that identify an advisory snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_digest(*columns: str):
    """SHA-256 over the JSON of a row's columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def parallel_digest(rows: DataFrame, *columns: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, records, digest``: a digest of the bag of rows, per key if given.

    Each row's SHA-256 is cut into eight words that are summed over all rows.
    Sums combine in any order, so this is one ordinary partial aggregate with
    constant state, whatever the number of rows or the size of a group.
    """
    by = keys or []
    word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(word(i)), F.lit(0)).cast("string") for i in range(8)]
    summed = rows.select(*by, record_digest(*columns).alias("h")).groupBy(*by).agg(
        F.count("*").alias("records"), F.concat_ws(":", F.count("*").cast("string"), *sums).alias("sums")
    )
    return summed.select(*by, "records", F.sha2("sums", 256).alias("digest"))


def snapshot_hash(records: DataFrame) -> str:
    """Content hash of an advisory set: the digest of the bag of (id, modified).

    One definition for every size, so that a snapshot keeps its hash family as it
    grows, and no row passes through the driver.
    """
    pairs = records.select("id", F.coalesce("modified", F.lit("")).alias("modified"))
    return "sha256:" + parallel_digest(pairs, "id", "modified").first().digest[:32]
