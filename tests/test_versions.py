import itertools

import pytest
from pyspark.sql import functions as F

from plumbline.functions import versions as v

ASCENDING = [
    "0.dev0", "0a1", "0", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a2", "1.0b1", "1.0c1.dev1", "1.0rc1", "1.0", "1.0+abc", "1.0+abc.2", "1.0+1", "1.0+10",
    "1.0.post1.dev1", "1.0.post1", "1.0-2", "1.0.1", "1.9", "1.10", "1.99999999999999999999999999999999999999999999", "2", "2!0.1",
]
EQUAL = [("1.0", "1.0.0"), ("v1.2", "1.2"), ("1.0alpha1", "1.0a1"), ("1.0-beta.2", "1.0b2"), ("1.0c1", "1.0rc1"), ("1.0preview3", "1.0rc3"), ("1.0-1", "1.0.post1"), ("1.0.rev2", "1.0.post2"), ("1.0a", "1.0a0"), (" 1.0 ", "1"), ("1.0DEV", "1.0.dev0"), ("1.0+A-b", "1.0+a.b"), ("007", "7")]
INVALID = ["", "not-a-version", "1..0", "1.0+", "french toast", "1.0x", "==1.0", None]


def keys(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", v.version_key(F.col("t")).alias("k")).collect()
    return {r.i: r.k for r in rows}


def test_order_is_strict(spark):
    k = keys(spark, ASCENDING)
    assert all(k[i] < k[i + 1] for i in range(len(ASCENDING) - 1))


def test_equivalent_spellings(spark):
    k = keys(spark, list(itertools.chain(*EQUAL)))
    assert [p for i, p in enumerate(EQUAL) if k[2 * i] != k[2 * i + 1]] == []


def test_invalid_versions_have_no_key(spark):
    assert set(keys(spark, INVALID).values()) == {None}


def test_facts(spark):
    df = spark.createDataFrame([("1!2.03.0rc1",), ("1.0.post2",), ("1.0.dev1",)], "t string").select(v.version_facts(F.col("t")).alias("f"))
    got = [(r.f.is_prerelease, r.f.is_postrelease, r.f.base_version) for r in df.collect()]
    assert got == [(True, False, "1!2.3.0"), (False, True, "1.0"), (True, False, "1.0")]


@pytest.mark.parametrize("a,b,want", [("1.0", "1.0.0", 0), ("1.0a1", "1.0", -1), ("2", "1!0", -1), ("1.0.1", "1.0", 1), ("x", "1", None)])
def test_compare(spark, a, b, want):
    assert spark.range(1).select(v.compare_versions(F.lit(a), F.lit(b))).first()[0] == want


def test_sort(spark):
    listed = F.array(*[F.lit(x) for x in ("1.10", "bad", "1.9", "1.0", "1.0.0")])
    assert spark.range(1).select(v.sort_versions(listed)).first()[0] == ["1.0", "1.0.0", "1.9", "1.10"]
