"""Hard negatives, decontamination and lexical search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn
from plumbline.llm.decontamination import ItemAutomaton, find_leaks
from plumbline.llm.hard_negatives import Best, Tree, hard_negatives, str_order
from plumbline.llm.lexical import SharingPlan, search
from plumbline.llm.terms import terms

nan, inf = float("nan"), float("inf")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if text else []


@given(st.text())
def test_terms_are_runs_of_the_stated_characters(text):
    assert [t.decode() for t in terms(text.encode("utf-8", "replace"))] == plain_words(text.encode("utf-8", "replace").decode())


# Hard negatives


def plain_negatives(rows, anchor, k=5):
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = set()
    for a in filter(anchor, rows):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if rows[i][0] == rows[a][0]][:k]:
            fit = [i for i in best if rows[i][0] != rows[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:k], 1)}
    return out


@pytest.mark.parametrize("tile, leaf, seed", [(8192, 64, 1), (16, 4, 2), (50, 8, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, tile, leaf, seed):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "ANCHORS", tile)
    draw = random.Random(seed)
    base = [[draw.gauss(0, 0.3) for _ in range(6)] for _ in range(12)]
    # Few directions and coarse components, so that equal vectors and equal scores abound; some scores are below 0.
    rows = [(i, draw.choice([0, 0, 0, 1, 2, -7, 10**12]), [round(x + draw.choice([0, 0, 0.1]), 1) for x in draw.choice(base)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(7)
    got = hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) == len({tuple(r) for r in got})


def test_trees_prune_and_lose_nothing():
    draw = np.random.default_rng(5)
    centres = draw.integers(-200, 200, (20, 8))
    vectors = (centres[draw.integers(0, 20, 5000)] + draw.integers(-9, 10, (5000, 8))).astype(np.int32)
    labels = draw.integers(0, 4, 5000).astype(np.int64)
    order = str_order(vectors, labels)
    assert sorted(order.tolist()) == list(range(5000))
    ids = np.arange(5000)[order]
    tree = Tree(ids, labels[order], vectors[order])
    seen = []

    class Counted(Best):
        def add(self, who, scores, ids, allowed):
            seen.append(scores.size)
            super().add(who, scores, ids, allowed)

    asked = vectors[:50].astype(float)
    best = Counted(np.full((50, 1), hn.NONE + 1), np.full((50, 1), -(hn.NONE + 1)), 5)
    hn.search(tree, np.arange(50), labels[:50], asked, True, best)
    scores = (vectors[:50].astype(int) @ vectors.astype(int).T)
    for a in range(50):
        fit = sorted((-s, i) for i, s in enumerate(scores[a].tolist()) if i != a and labels[i] == labels[a])[:5]
        assert [(-s, i) for s, i in zip(best.scores[a, 0].tolist(), best.ids[a, 0].tolist())] == fit
    assert sum(seen) < 0.35 * 50 * 5000  # boxes were left out


def test_odd_vectors(spark):
    rows = [
        (100, 1, [1.0, 0.0]),
        (100, 1, [1.0, 0.0]),  # a repeated row
        (1, 1, [0.9, 0.0]),
        (2, 1, [0.9]),  # shorter: filled up with 0, a tie
        (3, 2, [0.85, 0.3]),
        (4, 2, []),
        (5, None, [1.0, 0.0]),
        (6, 2, None),
        (7, 2, [1.0, None]),
        (8, 2, [nan, 1.0]),
        (9, 2, [inf, 1.0]),
        (10, 2, [1e30, 1.0]),
        (None, 2, [0.9, 0.0]),
        (200, 3, [-1.0, 0.0]),  # its best positive is negative
        (201, 3, [1.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank int, id string")
    got = {tuple(r) for r in hard_negatives(table, F.col("vec_id") % 100 == 0).collect()}
    s = lambda a, b: math.floor(256 * a) * math.floor(256 * b)
    assert got == {(100, p, r, n, s(1, 0.9), s(1, 0.85)) for p in (1, 2) for r, n in ((1, 3),)}
    assert hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(table.where("label is null"), F.col("vec_id") % 100 == 0).count() == 0


def test_one_vector_on_most_rows(spark):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(3000)] + [(3000 + i, i % 3, [0.5, i / 100]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in hard_negatives(table, F.col("vec_id") % 300 == 0).collect()} == plain_negatives(rows, lambda i: i % 300 == 0)


# Decontamination


def plain_leaks(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_equals_plain_windows(items, words, window):
    automaton = ItemAutomaton([(i, True, [w.encode() for w in item]) for i, item in enumerate(items)], window)
    spans, found, longest = automaton.matches([w.encode() for w in words])
    n, hit, names = plain_leaks(" ".join(words), [(i, " ".join(x)) for i, x in enumerate(items)], window)
    assert sum(b - a for a, b in spans) == hit and sorted(map(str, found)) == names
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    joined, item_texts = " ".join(words), [" ".join(x) for x in items]
    assert longest == 0 or any(" ".join(words[i : i + longest]) in t for i in range(n) for t in item_texts)


@pytest.mark.parametrize("shard_words, part_words", [(200_000, 50_000), (40, 15)])
def test_leaks_equal_plain_windows(spark, shard_words, part_words):
    draw = random.Random(3)
    vocabulary = ["Uno", "dos", "TRES", "quatre", "fünf", "ÉCLAIR", "x1", "9"]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, line(draw.randint(0, 45))) for i in range(20)] + [(20, "lone"), (20, "two words"), (None, "no id at all"), (21, None), (22, " ?! "), (23, "lone")]
    texts = [line(draw.randint(0, 60)) for _ in range(60)]
    texts += [f"{line(5)}. {draw.choice(items[:20])[1]}\n{line(4)}" for _ in range(40)]
    texts += ["A LONE wolf", "two, WORDS!", "no id at all, really", None, "", " \n ", "x" * 100_000, items[3][1].upper() + " ", "é" + items[3][1]]
    rows = [(i, t, 1, "x", ["y"]) for i, t in enumerate(texts)] + [(0, texts[0], 1, "x", ["y"]), (None, texts[61], 1, "x", ["y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int, data string, items array<string>")
    asked = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    got = find_leaks(docs, asked, shard_words=shard_words, part_words=part_words).collect()
    seen = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got)
    assert seen == sorted((str(r[0]), *plain_leaks(r[1], items)) for r in rows)
    for r in got:
        assert r.n_items == len(r["items"]) and r.rejected == (r.n_hit > 0.5 * r.n_words) and (r.longest > 0) == (r.n_hit > 0)
    assert find_leaks(docs.limit(0), asked).count() == 0
    assert [r.n_hit for r in find_leaks(docs.limit(3), asked.limit(0)).collect()] == [0, 0, 0]


def test_long_leaks_are_cut_out(spark):
    secret = "the answer to the seventh question of this test is forty two indeed"
    text = f"Before it: {secret.upper()}! After it; and much more text that nobody has ever asked a question about at all."
    docs = spark.createDataFrame([(1, text), (2, secret), (3, "clean Ünïcode text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, secret)], "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, items).collect()}
    assert got[1].clean_text == text.replace(secret.upper(), "") and not got[1].rejected and got[1].longest == len(secret.split())
    assert got[2].clean_text is None and got[2].rejected
    assert got[3].clean_text == "clean Ünïcode text"


def test_item_that_every_document_holds_and_a_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"w{i % 31}" for i in range(400_000))
    docs = spark.createDataFrame([(i, item) for i in range(500)] + [(500, long), (501, "w" * 3_000_000), (502, " " * 2_000_000)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert all(got[i].n_hit == 30 for i in range(500)) and got[501].n_hit == got[502].n_words == 0
    assert got[500].n_hit == sum(i % 31 < 30 for i in range(400_000 - 400_000 % 31)) + (400_000 % 31 if 400_000 % 31 >= 10 else 0)


# Lexical search


def plain_search(rows, items, k=10):
    words = [plain_words(t) for _, t in rows]
    n_docs, length = sum(bool(w) for w in words), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w, c in zip(rows, words, counts):
            score = 0
            for t in plain_words(text):
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * len(w) * n_docs) // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_items", [512, 3])
def test_search_equals_plain_scores(spark, block_items):
    draw = random.Random(4)
    vocabulary = [f"T{i}" for i in range(40)] + ["été", "ÉTÉ", "straße"]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows = [(i, line(draw.randint(0, 30))) for i in range(200)] + [(7, "T1 T2"), (None, "T1 t1 T2"), (300, None), (301, ""), (302, " ?! "), (303, "T3 " * 50_000)]
    rows += [(400 + i, "t5 t6 t7") for i in range(30)]  # ties
    shared = line(12)
    items = [(i, f"{shared} {line(draw.randint(0, 9))}") for i in range(8)] + [(8, "t5 T6, t6"), (9, None), (10, ""), (11, "unknown"), (None, "t1"), (8, "t2")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, n string").repartition(5)
    asked = spark.createDataFrame([(*x, 1) for x in items + items[:1]], "item_id long, text string, block int")
    got = search(docs, asked, block_items=block_items).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_search(rows, items)
    assert search(docs.limit(0), asked).count() == 0 and search(docs, asked.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=14), max_size=8))
def test_sharing_plan_adds_every_term_once(items):
    plan = SharingPlan([[w.encode() for w in x] for x in items])
    impacts = np.random.default_rng(0).integers(0, 1000, (len(plan.terms), 3))
    at = {t: i for i, t in enumerate(plan.terms)}
    want = np.array([sum((impacts[at[w.encode()]] for w in x), np.zeros(3, int)) for x in items]).reshape(len(items), 3)
    assert (plan.evaluate(impacts) == want).all()


def test_shared_terms_are_added_once():
    common = [f"c{i}".encode() for i in range(20)]
    plan = SharingPlan([common + [f"own{i}".encode()] for i in range(50)])
    assert plan.shared == 19 and len(plan.adds) == 19 + 50  # in place of 50 * 20


def test_items_are_named_by_digest(spark):
    from plumbline.llm.queries import op12_decontamination

    none = op12_decontamination(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert none.items_sha256 == hashlib.sha256(b"").hexdigest() and not none.contaminated
