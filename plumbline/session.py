"""Session settings and the durable scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from math import ceil

from pyspark import SparkConf
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that hold for any size of cluster. Partition counts are left to the
# deployment (or to AQE coalescing); only the local helper below pins them.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Text that one task parses, in bytes.
PARSE_BYTES = 32 << 20


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, whatever folder they start in.

    The sources are zipped once for each application and sent through Spark's own
    file server, so nothing has to be installed on the machines.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    app = spark.sparkContext.applicationId
    if _SHIPPED.get("app") == app:
        return
    folder = tempfile.mkdtemp(prefix="plumbline-code-")  # on the driver, which serves it
    where = os.path.join(folder, "plumbline_package.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(at, name)
                out.write(full, os.path.join("plumbline", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(where)
    _SHIPPED["app"] = app


_SHIPPED: dict[str, str] = {}


def spread(df: DataFrame, text: str) -> DataFrame:
    """Deals rows with long texts over enough tasks for their size.

    The number of tasks follows from the bytes of ``text``; it is at least the
    number of cores. Input that comes in as many parts already is not shuffled.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    tasks = max(ceil(size / PARSE_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def parts_for(spark: SparkSession, rows: int, a_task: int) -> int | None:
    """Parts to deal ``rows`` into so that a task takes ``a_task`` of them; None where the session's own number of parts is enough."""
    parts = ceil(rows / a_task)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def local_session(cpus: int | str = "*", app: str = "plumbline") -> SparkSession:
    """A local session for tests, the bench and the command line."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def engine_session(app: str = "plumbline") -> SparkSession:
    """The session of whoever submitted this program; a local one only where no master is set.

    A running session is used as it is. Otherwise the master that spark-submit or
    the defaults file name stays, and the settings of the engine are added.
    """
    running = SparkSession.getActiveSession()
    if running is None and not SparkConf().get("spark.master", os.environ.get("MASTER")):
        return local_session(app=app)
    spark = running
    if spark is None:
        builder = SparkSession.builder.appName(app)
        for key, value in ENGINE_CONF.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    every executor shares this machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize_counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared scratch folder, read it back, count its rows.

    Unlike a cached block, the written table outlives a lost executor, and the
    planner sees its true size when it picks a join strategy. The count is taken
    while writing, without a second pass.
    """
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def bucketed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder in buckets of ``keys``, sorted by them, and read it back.

    A join or aggregate on these keys reads the buckets where they lie; it never
    shuffles this side again. There are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _WRITTEN.append(path)
    _TABLES.append(name)
    # One task for each bucket, so that it is one file.
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


_WRITTEN: list[str] = []
_TABLES: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Removes the intermediate tables this program wrote; call it when its results are written."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """As ``materialize_counted``, without the count."""
    return materialize_counted(df, tag)[0]
