"""Nulls, empty and very long texts, repeats, ties, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.embedding_dedup import near_duplicate_vectors
from plumbline.llm.langid import identify
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mixing_rates
from plumbline.llm.order_minhash import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.pii import pseudonymise
from plumbline.llm.suffix_repeats import repetition
from plumbline.llm.toxicity import toxicity, without_toxic
from plumbline.llm.unigram_count import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, mark string, line string, "
    "site string, row string, tokens long, posteriors string, mix_key string, pii_found string, found string, length long, piece int, "
    "mix_rate double, mix_tokens string, mix_copies string, mix_posteriors string, n_lines string, n_removed string, n_hit string, items string, rank int"
)
ROWS = [
    (1, SAME, "en", "a"),
    (1, SAME, "en", "a"),  # a repeated row
    (2, SAME, None, None),
    (2, "another text under an id that ties", "en", "b"),
    (3, "", "en", "a"),
    (4, None, "en", "c"),
    (None, SAME, "fr", "a"),
    (None, "no id, no twin: du texte en plus", "fr", "a"),
    (None, None, None, None),
    (5, LONG, "en", "d"),
    (6, " \n\t\n ", "en", "a"),
    (7, "x" * 30_000, "fr", "a"),
    (8, "4111 1111 1111 1111 a@b.example 10.1.2.3 \x01 \x02", "fr", "a"),
]
LABELS = [(1, 1, 0), (1, 1, 1), (2, None, None), (3, 1, 0), (None, 1, 1), (5, 0, 0), (8, 1, 1)]

OPERATORS = {
    "pii": lambda s, d, l: pseudonymise(d, "key"),
    "mixing": lambda s, d, l: mixing_rates(d, d.select("doc_id", F.col("lang").alias("domain")), {"en": 1, "fr": 1}),
    "langid": lambda s, d, l: identify(d),
    "toxicity": lambda s, d, l: toxicity(d, l),
    "minhash": lambda s, d, l: near_duplicates(d),
    "packing": lambda s, d, l: pack(d, BPE),
    "repeats": lambda s, d, l: repetition(d),
    "lines": lambda s, d, l: line_dedup(d, min_sites=2),
    "unigram": lambda s, d, l: token_counts(d, PIECES),
}


@pytest.fixture(scope="module")
def tables(spark):
    more = (1, 0.5, True, "m", "l", "s", "r", 3, "p", "k", "f", "f", 9, 9, 0.5, "t", "c", "p", "n", "n", "h", "i", 4)
    docs = spark.createDataFrame([(*r, *more) for r in ROWS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    return docs, labels


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, tables, name):
    docs, labels = tables
    got = OPERATORS[name](spark, docs, labels).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    want = sorted(str(r[0]) for r in ROWS)
    if name == "packing":  # more than one piece of long texts
        assert set(ids) == set(want) and sum(r["piece"] == 0 for r in got) == len(ROWS)
    else:
        assert ids == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tables, name):
    docs, labels = tables
    assert OPERATORS[name](spark, docs.limit(0), labels.limit(0)).count() == 0


def test_vectors_that_are_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [0.0, 1.0, 0.0]), (None, [1.0, 0.01])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, mark string, node long")
    got = {(r.vec_id, i): r for i, r in enumerate(near_duplicate_vectors(table).collect())}
    by_id = {}
    for (vec, _), r in got.items():
        by_id.setdefault(vec, []).append((r.n_links, r.component_id, r.kept))
    assert len(got) == len(rows)
    assert by_id[1] == [(3, 1, True)] * 2 and by_id[2] == [(3, 1, False)] and by_id[None] == [(3, 1, False)]
    for alone in (3, 4, 5, 6, 7, 8, 9):
        assert by_id[alone] == [(0, alone, True)]
    assert near_duplicate_vectors(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    docs, labels = tables
    where = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{where}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{where}/labels.parquet")
    return where


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_and_empty_rows(spark, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage(spark, docs, folder)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert got.count() > 0
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_leave_clashing_columns_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, folder)
        for column, value in (("mix_copies", "c"), ("n_lines", "n"), ("mark", "m"), ("tokens", 3)):
            assert {r[0] for r in got.select(column).distinct().collect()} == {value}


def test_one_class_of_labels_keeps_every_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(docs, labels).collect()} == {(0.5, 0)}
    assert without_toxic(docs, labels).count() == len(ROWS)


def test_very_long_texts(spark):
    """Two million blanks, line breaks or both, and one word of five million letters."""
    long = [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000, "x" * 5_000_000, "a " * 1_000_000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(long)], "doc_id long, text string, lang string, source string").repartition(len(long))
    labels = spark.createDataFrame([(9, 0, 0)], "doc_id long, quality int, toxic int")
    tokenizer = Tokenizer.from_file(BPE)
    pieces = pack(docs, BPE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(long)}
    for name in ("toxicity", "minhash", "lines", "mixing", "langid"):
        assert sorted(r["doc_id"] for r in OPERATORS[name](spark, docs, labels).select("doc_id").collect()) == list(range(len(long)))


def test_characters_that_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("½ ² ① 3 _", None), ("ªb", None), ("ⅷ", None), *[("the cat sat", "en"), ("der Hund lag", "de")] * 40])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, fold=None).collect()}
    assert got[0] == got[2] == "und" and got[1] != "und" and got[3] == "en" and got[4] == "de"


def test_an_id_with_two_languages_is_learned_with_its_own_texts(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "der Hund lag auf der Matte", "de")]
    got = sorted((r.lang_pred) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fold=None).collect())
    assert got == ["de", "en"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
