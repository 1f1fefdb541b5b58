"""Decisions of the pipeline's stages on rows made for them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def test_one_of_each_class_stays(spark):
    rng = random.Random(1)
    base, other = words(rng, 120), words(rng, 90)
    near = base.replace(base.split()[40], "changed")
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "c"), (4, other, "en", "a"), (4, other, "en", "a"), (2, words(rng, 60), "en", "a"), (None, base, "en", "z"), (5, None, "en", "a")]
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, table(spark, rows), SF).collect())
    assert got == [(1, base), (2, rows[5][1]), (4, other), (5, None)]


def test_toxic_rows_go_whatever_their_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    english = docs.where("lang = 'en'").join(labels, "doc_id")
    toxic, clean = english.where("toxic = 1").select("doc_id"), docs.join(labels.where("toxic = 0"), "doc_id").select("doc_id")
    left = lambda ids: kept.join(ids, "doc_id", "left_semi").count()
    assert left(toxic) <= 0.3 * toxic.count() and left(clean) >= 0.97 * clean.count()


def test_documents_of_nothing_but_boilerplate_go(spark):
    rows = [(i, f"the same notice for all\nown {i}", "en", f"s{i}") for i in range(8)] + [(20, "the same notice for all", "en", "s20")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, table(spark, rows), SF).collect()}
    assert 20 not in got and got[0][0] == rows[0][1] and got[5] == ("own 5", 5)


def test_mixing_keeps_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.count()
    share = lambda d: {r.lang: r.s for r in d.groupBy("lang").agg(F.sum("n_chars").alias("s")).collect()}
    before, after = share(docs), share(mixed)
    assert after["en"] == pytest.approx(before["en"], rel=0.05) and after["es"] > 1.1 * before["es"]
