"""A corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mixing_rates
from plumbline.llm.order_minhash import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.queries import byte_bpe, table, tempered
from plumbline.llm.toxicity import without_toxic
from plumbline.session import scratch_dir

ROW = "__row"


def carried(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` with all columns but those an operator reads in one struct, so that no name can clash with what it adds."""
    return docs.select(*read, F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c not in read]).alias(ROW))


def unpacked(docs: DataFrame, *read: str) -> list:
    """The columns of ``docs`` from what ``carried`` made of them."""
    return [F.col(c) if c in read else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at the cut or above go; every row is judged by its own text."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and with them the documents that consist of nothing else."""
    read = ("doc_id", "text", "source", "n_chars")
    done = line_dedup(carried(docs, *read))
    done = done.where(~((F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(unpacked(docs, *read))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    verdict = near_duplicates(docs).groupBy(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key")).agg(
        F.max("kept").alias("__near_kept"), F.count(F.lit(1)).alias("__near_rows")
    )
    same = docs["doc_id"].eqNullSafe(F.col("__near_id")) & F.unhex(F.md5(docs["text"])).eqNullSafe(F.col("__near_key"))
    kept = docs.join(verdict, same).where("__near_kept")
    # Equal rows come down to one; different texts that share an id are judged each by its own class.
    many = kept.where("__near_rows > 1").dropDuplicates(["__near_id", "__near_key"])
    return kept.where("__near_rows = 1").select(docs.columns).unionByName(many.select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small languages are repeated until the languages' tokens are in tempered proportion; none is left out."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    read = ("doc_id", "text")
    done = mixing_rates(carried(docs, *read), labelled, tempered, keep_all=True)
    times = F.greatest(F.col("mix_copies"), F.lit(1))
    return done.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(unpacked(docs, *read))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences of at most 2048 tokens."""
    return pack(docs, byte_bpe)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", one_of_each),
    ("mixing", mix),
    ("packing", pack_documents),
]

# A classifier, sketches and a tokenizer are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{base}/{at}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
