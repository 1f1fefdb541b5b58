"""The registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontamination import find_leaks
from plumbline.llm.embedding_dedup import near_duplicate_vectors
from plumbline.llm.hard_negatives import hard_negatives
from plumbline.llm.langid import identify
from plumbline.llm.lexical import search
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mixing_rates
from plumbline.llm.order_minhash import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.pii import pseudonymise
from plumbline.llm.suffix_repeats import repetition
from plumbline.llm.toxicity import toxicity
from plumbline.llm.unigram_count import token_counts

KEY = "a key that each deployment replaces"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The public byte-level vocabulary; looked up where the tokenizer runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    """The public piece vocabulary, whose scores are read as those of a unigram model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY).select("doc_id", "pii_found", "text")


def tempered(shares: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Shares raised to a power under 1, which lifts small domains."""
    raised = {d: s**power for d, s in shares.items()}
    return {d: s / sum(raised.values()) for d, s in raised.items()}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    done = mixing_rates(docs, labelled, tempered)
    return done.select("doc_id", "mix_tokens", "mix_posteriors", "mix_rate", "mix_copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op10_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), piece_model)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = F.sha2(F.concat_ws(",", "items"), 256)
    return done.select("doc_id", "n_words", "n_hit", "n_items", found.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_pii_pseudonyms,
        op3_mixing,
        op4_language_id,
        op5_toxicity,
        op6_order_minhash,
        op7_packing,
        op8_suffix_repeats,
        op9_line_dedup,
        op10_unigram_count,
        op11_hard_negatives,
        op12_decontamination,
        op13_lexical_search,
    )
}

ORACLES = {
    # Every pair by brute force, then components by spreading the smallest id.
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     links AS (SELECT a.vec_id AS s, b.vec_id AS d FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
     reach AS (SELECT s, d FROM links UNION SELECT r.s, l.d FROM reach r JOIN links l ON l.s = r.d),
     low AS (SELECT s, min(d) AS d FROM reach GROUP BY s)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.s = v.vec_id) AS n_links,
       least(v.vec_id, coalesce(low.d, v.vec_id)) AS component_id, v.vec_id <= coalesce(low.d, v.vec_id) AS kept
FROM v LEFT JOIN low ON low.s = v.vec_id""",
    # Exact counts of sites; the first place of a boilerplate line stays. Equal rows (id and text) are one document.
    "op9_line_dedup": """
WITH docs AS (SELECT doc_id, text, coalesce(source, '') AS site, md5(concat_ws(chr(10), coalesce(CAST(doc_id AS VARCHAR), ''), text)) AS k FROM documents),
     lines AS (SELECT doc_id, k, site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM docs WHERE text IS NOT NULL),
     marked AS (SELECT *, length(trim(line, ' ')) >= 1 AS counts FROM lines),
     wide AS (SELECT line FROM marked WHERE counts GROUP BY line HAVING count(DISTINCT site) >= 5),
     placed AS (SELECT doc_id, k, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, k, pos) AS nth FROM marked JOIN wide USING (line) WHERE counts),
     gone AS (SELECT k, pos FROM placed WHERE nth > 1),
     kept AS (SELECT m.k, string_agg(m.line, chr(10) ORDER BY m.pos) AS text FROM marked m LEFT JOIN gone g ON m.k = g.k AND m.pos = g.pos WHERE g.k IS NULL GROUP BY m.k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.k = d.k) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM docs d LEFT JOIN kept ON kept.k = d.k""",
    # Every anchor against every row; positives and windows as they are defined.
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT a.id AS anchor_id, v.id, v.label = a.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
                FROM v a JOIN v ON a.id % 100 = 0 AND v.id <> a.id),
     positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5""",
    # Windows as joined words, looked up at every place of every document.
    "op12_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
                 FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     places AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
                FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
     hits AS (SELECT p.r, p.i, p.size, x.item_id FROM places p JOIN windows x USING (size, words)),
     hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
     named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
     corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
     tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
     df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM corpus) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf GROUP BY term),
     lengths AS (SELECT r, doc_id, 100 - 75 + (CAST(75 * len(w) AS BIGINT) * n_docs) // length AS m FROM d, corpus WHERE len(w) > 0),
     parts AS (SELECT r, term, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tf JOIN df USING (term) JOIN lengths USING (r)),
     scores AS (SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN parts USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10""",
}
