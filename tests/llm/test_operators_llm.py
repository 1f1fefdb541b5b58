"""The operators against plain versions on small inputs."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import blake2b

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from plumbline.llm import langid, line_dedup, mixing, order_minhash, packing, pii, suffix_repeats, toxicity, unigram_count
from plumbline.llm.common import Scratch, components, sample_by_class
from plumbline.llm.embedding_dedup import near_duplicate_vectors

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert {r.node: r.component for r in got} == groups(edges, nodes)


# -- vectors ---------------------------------------------------------------------
def test_forest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 24))
    near = base[:300] + rng.normal(size=(300, 24)) * 0.2
    tight = base[0] + rng.normal(size=(700, 24)) * 0.01  # a group that no cut makes smaller
    rows = np.concatenate([base, near, tight, base[:40], base[:40] * 3])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    pairs = np.argwhere(np.triu(linked))
    found = sum(n for n, _ in got.values()) / linked.sum()
    assert 0.999 <= found <= 1
    want = groups(pairs.tolist(), range(len(rows)))
    assert sum(got[i][1] == want[i] for i in want) >= len(rows) - 2


# -- personal data ------------------------------------------------------------------
def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


PII = [
    ("mail a.bc.34@mail7.example.com x", 1),
    ("call +1 (017) 555-7713 now, again +1 (017) 555-7713", 2),
    ("ip 97.51.17.173 but not 300.1.1.1", 1),
    ("card 4111 1111 1111 1111 but not 4111111111111112", 1),
    ("ssn 123-45-6789 but not 000-12-3456", 1),
    ("2024-02-29, not 2023-02-29; 31/12/1999 and 01.02.2003.", 3),
    ("iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", 2),
    ("\x01\x02a 10.0.0.1 \x02", 1),
]


def test_pseudonyms_keep_formats_link_and_come_back(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII)] + [(50, PII[0][0] + " elsewhere")], "doc_id int, text string")
    done = pii.pseudonymise(table, "secret")
    got = {r.doc_id: r for r in done.collect()}
    for i, (text, n) in enumerate(PII):
        new = got[i].text
        assert got[i].pii_found == n and (len(new) == len(text) or i in (2, 7)), text
        shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
        if i not in (0, 2, 6, 7):
            assert shape(new) == shape(text) and new != text
    assert got[0].text[5:30] == got[50].text[5:30] != PII[0][0][5:30]
    assert luhn(got[3].text[5:24]) and got[3].text.endswith("4111111111111112") and "300.1.1.1" in got[2].text
    halves = got[1].text.split(" now, again ")
    assert halves[0][5:] == halves[1] and halves[1] != "+1 (017) 555-7713"
    back = {r.doc_id: r.text for r in pii.pseudonymise(done, "secret", back=True).collect()}
    assert [back[i] for i in range(len(PII))] == [t for t, _ in PII]
    other = {r.doc_id: r.text for r in pii.pseudonymise(table, "another").collect()}
    assert all(other[i] != got[i].text for i in range(len(PII)))


def test_cards_and_accounts_beside_other_numbers_are_found(spark):
    card, apart, account = "4111111111111111", "4111 1111 1111 1111", "ES9121000418450200051332"
    texts = [card, f"{card} 12 items", f"12 {card}", apart, f"{apart} 123", f"1234 {apart}", account, f"{account} BIC", f"{account} 2024", "ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1332 2024", f"on {card} 2024-02-29"]
    done = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "secret")
    got = [r.text for r in done.orderBy("doc_id").collect()]
    one, two, three, four = got[0], got[3], got[6], got[9]
    assert got[1:3] == [f"{one} 12 items", f"12 {one}"] and got[4:6] == [f"{two} 123", f"1234 {two}"]
    assert got[7:9] == [f"{three} BIC", f"{three} 2024"] and got[10] == f"{four} 2024"
    assert got[11].startswith(f"on {one} ") and "2024-02-29" not in got[11]
    assert not {one, two, three, four} & set(texts)
    back = [r.text for r in pii.pseudonymise(done, "secret", back=True).orderBy("doc_id").collect()]
    assert back == texts


def test_feistel_is_a_permutation(spark):
    all_values = spark.range(189).crossJoin(spark.range(20).withColumnRenamed("id", "low"))
    moved = all_values.select(pii.feistel(F.array("id", "low"), F.array(F.lit(189).cast("long"), F.lit(20).cast("long")), "k", "x").alias("m"))
    assert moved.distinct().count() == 189 * 20
    assert moved.where((F.col("m")[0] >= 189) | (F.col("m")[1] >= 20)).count() == 0


# -- mixing ------------------------------------------------------------------------
def test_rates_meet_the_targets(spark, docs):
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    goal = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    rows = mixing.mixing_rates(docs, labelled, goal).collect()
    total = Counter()
    for r in rows:
        for d, p in r.mix_posteriors.items():
            total[d] += r.mix_rate * r.mix_tokens * p
    whole = sum(r.mix_tokens for r in rows)
    assert all(abs(total[d] / whole - w) < 0.01 for d, w in goal.items())
    assert min(r.mix_rate for r in rows) >= 0 and all(abs(r.mix_copies - r.mix_rate) <= 1 for r in rows)
    right = sum(max(r.mix_posteriors, key=r.mix_posteriors.get) == r.lang for r in rows)
    assert right >= 0.97 * len(rows)
    # The distributed passes equal plain projected gradient steps over all rows at once.
    domains = sorted(goal)
    tokens = np.array([float(r.mix_tokens) for r in rows])
    shares = np.array([[r.mix_posteriors[d] for d in domains] for r in rows])
    now = tokens @ shares
    rates = np.ones(len(rows))
    target = whole * np.array([goal[d] for d in domains])
    for _ in range(24):
        error = (rates * tokens) @ shares - target
        rates = np.maximum(0, rates - (shares @ (error / now) + 1e-3 * (rates - 1)) / 1.001)
    assert np.allclose(rates[tokens > 0], np.array([r.mix_rate for r in rows])[tokens > 0], atol=1e-4)


def test_keep_all_never_shrinks(spark, docs):
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    rows = mixing.mixing_rates(docs, labelled, {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, keep_all=True).collect()
    assert min(r.mix_rate for r in rows) > 0.9


def test_more_than_64_domains_are_learned(spark):
    keys = spark.createDataFrame([(f"{d}-{i}", f"d{d:02d}") for d in range(70) for i in range(3 if d else 50)], "doc_id string, domain string")
    drawn = {r["domain"]: r["count"] for r in sample_by_class(keys, "domain", 10).groupBy("domain").count().collect()}
    assert len(drawn) == 70 and all(n == 3 for d, n in drawn.items() if d != "d00") and drawn["d00"] < 25
    model = mixing.train(keys.select("doc_id", F.col("domain").alias("text")), keys, "doc_id", "text", "domain", 10)
    assert len(model.domains) == 70


def test_a_repeated_id_gives_one_text_to_learn_from(spark, monkeypatch):
    rows = [(1, f"the house number {i} is old", "en") for i in range(200)] + [(i, "das Haus ist alt", "de") for i in range(2, 8)]
    seen = []
    monkeypatch.setattr(langid, "fit_kernel", lambda samples, *_: seen.extend(samples))
    langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"), "doc_id", "text", "lang", 300, 8, 0.05, None)
    assert len(seen) == 7


# -- language and toxicity, held out -------------------------------------------------
def test_language_held_out_accuracy(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in got) and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_language_without_letters(spark, docs):
    odd = spark.createDataFrame([(10**6 + i, t, None, None, 0) for i, t in enumerate([None, "", "12 34 !", "été"])], docs.schema)
    got = {r.doc_id - 10**6: r for r in langid.identify(docs.unionByName(odd)).where(f"doc_id >= {10**6}").collect()}
    assert [got[i].lang_pred == "und" for i in range(4)] == [True, True, True, False]


def test_toxicity_held_out(docs, labels):
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    english = [r for r in got if r.lang == "en"]
    toxic = [r.predicted for r in english if r.toxic == 1]
    assert sum(toxic) >= 0.7 * len(toxic)
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(clean) <= 0.03 * len(clean)


def test_swapping_identity_terms_is_penalised():
    # Toxic sentences happen to mention one group more often.
    rng = random.Random(1)
    vocabulary = ["gay", "straight", "idiot", "nice", "day"]
    samples = []
    for _ in range(400):
        bad = rng.random() < 0.5
        words = ([2] if bad and rng.random() < 0.7 else []) + ([0] if rng.random() < (0.8 if bad else 0.2) else [1]) + [rng.choice([3, 4])]
        samples.append((int(bad), sorted(words)))
    groups_ = (("gay", "straight"),)
    free = toxicity.fit_counterfactual(samples, vocabulary, groups_, 0.0, 1e-3)
    held = toxicity.fit_counterfactual(samples, vocabulary, groups_, 5.0, 1e-3)
    gap = lambda m: abs(m.score("a gay person on a day") - m.score("a straight person on a day"))
    assert gap(held) < 0.1 < gap(free)
    assert held.score("idiot") > 0.7


def test_fronts_of_identity_terms_are_swapped_with_them(spark):
    """Toxic labels mention one group more often; the weight must not move to the fronts of its terms."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bad = i % 2
        words = ["idiot"] * (bad and rng.random() < 0.6) + ["muslim" if rng.random() < (0.9 if bad else 0.1) else "christian"]
        rows.append((i, " ".join(words + [rng.choice(["nice", "day", "walk"])]), bad))
    table = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    train = lambda penalty: toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), "doc_id", "text", "toxic", toxicity.IDENTITY_TERMS, 2000, 4096, penalty, 1e-3, None)
    logit = lambda p: np.log(p / (1 - p))
    gap = lambda m: abs(logit(m.score("a muslim on a walk")) - logit(m.score("a christian on a walk")))
    assert gap(train(5.0)) < 0.4 < gap(train(0.0))
    at = {w: i for i, w in enumerate(["^musl", "^musli", "christian", "muslim"])}
    gone = [c for c in toxicity.swaps_of({"muslim", "muslin"}, (("muslim", "christian"),), at)]
    assert gone == [((3,), (2,)), ((3,), ())]  # the other word keeps the fronts


# -- near duplicates ------------------------------------------------------------------
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment_equals_the_plain_table():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = [c if rng.random() > 0.2 else rng.choice("abcd") for c in a if rng.random() > 0.1] if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        true = levenshtein(a, b)
        assert not a or not b or order_minhash.advance_columns(a, b, 60) == true
        for most in (0, 2, 5, 30):
            assert order_minhash.edit_distance(a, b, most) == (true if true <= most else most + 1)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_share_a_class_and_others_do_not(spark):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows, want = make(60), [], {}
    for group in range(12):
        base = make(rng.choice([40, 150, 800]))
        ids = []
        for copy in range(rng.choice([1, 2, 5])):
            text = base if copy % 2 == 0 else edited(rng, base, max(1, len(base) // 60))
            ids.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        want.update({i: ids[0] for i in ids})
    for _ in range(150):  # one passage, otherwise unlike: a large bucket without links
        want[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(passage + make(70))))
    order = rows[:]
    rng.shuffle(order)
    got = order_minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_classes_are_joined_across_a_bucket(spark, monkeypatch):
    """A chain whose ends are unlike the bucket's head is found by comparing the rest of the bucket."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    chain = [base]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 6))
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    for block in (512, 2):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.95).collect()
        assert {r.class_id for r in got} == {0}


def test_two_members_of_a_mixed_bucket_that_share_one_band_are_linked(spark, monkeypatch):
    """Scattered edits leave few common bands, and the bucket's head is unlike both texts."""
    rng = random.Random(12)
    rows, want = [], {}
    while len(rows) < 12:
        a = [f"w{rng.randrange(10**5)}" for _ in range(300)]
        b = edited(rng, a, 36)
        sa, sb = order_minhash.sketch(a, 16, 3), order_minhash.sketch(b, 16, 3)
        bands = np.flatnonzero(sa == sb)
        if not 1 <= len(bands) <= 2:
            continue
        band = int(bands[0])
        # The three shingles of the band, in text order, start a text that is otherwise unlike.
        keys = order_minhash.shingles(a)
        value = (order_minhash.mix(keys + order_minhash.occurrences(keys)) ^ order_minhash._SEEDS[band]) * order_minhash._PRIMES[1]
        value ^= value >> np.uint64(32)
        start = [w for at in sorted(np.argsort(value)[:3]) for w in a[at : at + 5]]
        low = min(mark_of(a), mark_of(b))
        for _ in range(3000):
            head = start + [f"h{rng.randrange(10**6)}" for _ in range(20)]
            if mark_of(head) < low and order_minhash.sketch(head, 16, 3)[band] == sa[band]:
                break
        else:
            continue
        n = len(rows)
        rows += [(n, " ".join(head)), (n + 1, " ".join(a)), (n + 2, " ".join(b))]
        want.update({n: n, n + 1: n + 1, n + 2: n + 1})
    for block in (512, 2):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.class_id for r in got} == want


def test_random_texts_have_the_classes_of_all_pairs(spark, monkeypatch):
    """Every two texts that share a band, aligned one by one; groups drift, so buckets stay mixed."""
    rng = random.Random(21)
    texts = []
    for _ in range(10):
        group = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([9, 30, 120]))]]
        for _ in range(14):
            group.append(edited(rng, rng.choice(group), max(1, int(len(group[0]) * rng.choice([0.03, 0.06, 0.12])))))
        texts += group
    marks = [mark_of(t) for t in texts]
    sketches = [order_minhash.sketch(t, 16, 3) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if (sketches[i] == sketches[j]).any() and (marks[i] == marks[j] or levenshtein(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)):
                links += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: min(j for j in range(len(texts)) if top(j) == top(i)) for i in range(len(texts))}
    assert links > 100 and len(set(want.values())) > 12
    for block in (512, 4):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        got = order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
        assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_bounds_never_exceed_the_edits():
    rng = random.Random(22)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
        b = [c if rng.random() > 0.2 else rng.choice("abcdefgh") for c in a if rng.random() > 0.1] or ["a"]
        b[rng.randrange(len(b)) : 0] = rng.choices("abc", k=rng.randint(0, 3))
        edits = levenshtein(a, b)
        apart = lambda f: int(np.abs(f(a).astype(int) - f(b)).sum())
        assert order_minhash.may_align(order_minhash.profile(a), order_minhash.profile(b), edits)
        assert apart(order_minhash.bag) + abs(len(a) - len(b)) <= 2 * edits


def mark_of(words):
    return blake2b(" ".join(words).encode(), digest_size=16).digest()


# -- packing --------------------------------------------------------------------------
def test_packing_round_trip_and_bound(spark, docs):
    tokenizer = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, lambda: BPE).collect()
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(parts):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d]) and (len(ids[d]) > 2048 or len(parts) == 1)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) <= 2048
    bound = packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert bound <= len(by_sequence) <= bound + 2


def test_lower_bound_never_exceeds_an_optimum():
    rng = random.Random(5)

    def optimum(items, size):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= size:
                    bins[b] += items[i]
                    place(i + 1, bins)
                    bins[b] -= items[i]
            place(i + 1, bins + [items[i]])

        place(0, [])
        return best

    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        bins, offsets, n = packing.best_fit_decreasing(np.array(items), 20)
        assert packing.lower_bound(np.array(items), 20) <= optimum(items, 20) <= n
        assert max(np.bincount(bins, items)) <= 20


def test_ids_equal_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(BPE), packing.Encoder(BPE)
    rng = random.Random(6)
    odd = ["", " ", "  a b", "a   b", "a \n b", "a\n  b", "<|endoftext|> x <|endoftext|>", "é b", "日本語 😀", "x" * 3000]
    odd += ["".join(rng.choice("ab \n\t.'s19é ") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in odd:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


# -- repetition -------------------------------------------------------------------------
def plain_repeats(text, least):
    w = suffix_repeats.WORD.findall(text or "")
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    three = Counter(zip(w, w[1:], w[2:]))
    short = {i + d for i in range(n - 2) if three[tuple(w[i : i + 3])] > 1 for d in range(3)}
    long = {i + d for i in range(n) if best[i] >= least for d in range(best[i])}
    return len(short), len(long), max(best, default=0)


def test_suffix_arrays_equal_brute_force():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "a b c d e f g h " * 4]
    got = suffix_repeats.measure(4)()([list(range(len(texts))), texts])
    found = list(zip(got["n_repeat_words"], got["covered_words"], got["longest_repeat"]))
    assert found == [plain_repeats(t, 4) for t in texts]


def test_base_columns_and_verdicts(spark):
    clean = " ".join(f"u{i}" for i in range(80))
    rows = [(1, clean), (2, "few words"), (3, ("a b c d e f g h i j " * 12)), (4, clean + "\n" + clean), (5, "# x\n# x\n\n\n$5 <y>" + clean), (6, clean + " " + " ".join(f"u{i}" for i in range(70)))]
    got = {r.doc_id: r for r in suffix_repeats.repetition(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 6)] == [True, False, False, False, False]
    assert got[2].base_failed and got[3].base_failed and not got[1].base_failed
    assert (got[5].n_symbols, got[5].n_dup_lines, got[4].n_dup_lines) == (5, 1, 1)


# -- lines ------------------------------------------------------------------------------
def test_lines_of_many_sites_go_but_the_first(spark):
    rng = random.Random(11)
    shared = {k: f"shared line on {k} sites" for k in range(1, 13)}
    rows = []
    for site in range(12):
        own = [shared[k] for k in range(1, 13) if site < k] + [f"own {site} {i}" for i in range(3)] + ["", "  "]
        rng.shuffle(own)
        rows.append((site, "\n".join(own), f"s{site}"))
    rows.append((20, "\n".join([shared[6]] * 3), "s0"))
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string, source string"), min_sites=5).collect()}
    seen = set()
    for doc, text, _ in rows:
        want = []
        for line in text.split("\n"):
            k = int(line.split()[3]) if line.startswith("shared") else 0
            if k >= 5 and line in seen:
                continue
            seen.add(line)
            want.append(line)
        assert got[doc].text == "\n".join(want) and got[doc].n_removed == len(text.split("\n")) - len(want)


# -- token counts -------------------------------------------------------------------------
def test_counts_equal_the_tokenizer(docs):
    pieces = unigram_count.read_pieces(PIECES)
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = ["a", " ", "  a  b ", "\n", "▁x▁▁y", "日本語 テスト😀😀", "<0x41> <s></s><unk>", "x" * 300, "\x00\x01", "a\tb\n\nc"]
    count = unigram_count.counter(PIECES).text
    for text in odd + [r.text for r in docs.limit(300).collect()]:
        assert count(text)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_ties_and_unknown_characters_without_bytes():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), ("▁a", -3.0), ("aba", -6.0)]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = unigram_count.UnigramCounter(pieces)
    rng = random.Random(12)
    for _ in range(500):
        text = "".join(rng.choice("ab xy") for _ in range(rng.randint(1, 14)))
        assert counter.text(text)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_order_minhash_fetches_texts_once(spark, monkeypatch):
    """Whole texts are read and moved for the first pairs only; mixed buckets, within and across blocks, use the same ones."""
    calls = []
    fetch = order_minhash.texts_of
    monkeypatch.setattr(order_minhash, "texts_of", lambda *given: calls.append(1) or fetch(*given))
    monkeypatch.setattr(order_minhash, "BLOCK", 2)
    same = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*same, *[f"d{n}x{i}" for i in range(30)]])) for n in range(8)]
    rows += [(100 + n, f"{text} {text.split()[0]}") for n, text in rows]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {n: n % 100 for n, _ in rows}
    assert len(calls) == 1
