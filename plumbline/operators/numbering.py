"""Ordinals over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a long ``name``: 1, 2, ... in ``order``. Rows that tie get different numbers in any order.

    A range-partitioned sort is written; the place of a row within its partition
    plus the sizes of the partitions before it is its number. Only those sizes, one
    row for each partition, pass through the driver. No window over everything.
    """
    at = F.monotonically_increasing_id()
    placed = materialize(df.orderBy(*order).withColumn("__at", at), "ordered")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    before, offsets = 0, []
    for size in sizes:
        offsets.append((size["__part"], before))
        before += size["n"]
    starts = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__before") + row + 1).drop("__part", "__before", "__at")
