"""The SQL functions against the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions.versions import version_key
from plumbline.sql import register

VERSIONS = [
    None, "", "x", "1", "v1.0", " 1.0.0 ", "0", "0.0", "00.010", "1!2.3", "1.0a", "1.0alpha2", "1.0-beta.3", "1.0c4", "1.0preview", "1.0rc", "1.0.post",
    "1.0-7", "1.0rev3", "1.0.dev", "1.0.dev5", "1.0a1.post2.dev3", "1.0.post1.dev2", "1.0+local", "1.0+LoC.001-x_2", "1.0+", "1..0", "9" * 30, "1.0\n", "1.0\u00012", "2!0",
]


@pytest.fixture(scope="module")
def registered(spark):
    register(spark)
    return spark


def test_key_equals_the_column_function(registered):
    df = registered.createDataFrame([(v,) for v in VERSIONS], "v string")
    rows = df.select("v", version_key(F.col("v")).alias("column"), F.expr("version_key(v)").alias("sql")).collect()
    assert [(r.v, r.sql) for r in rows] == [(r.v, r.column) for r in rows]
    assert sum(r.sql is not None for r in rows) >= 22


def test_between(registered):
    ask = lambda args: registered.sql(f"SELECT version_between({args}) AS hit").first().hit
    assert ask("'1.0', '0', '1.1', NULL") and not ask("'1.1', '0', '1.1', NULL") and ask("'1.1', '0', NULL, '1.1'")
    assert not ask("'1.0rc1', '1.0', NULL, NULL") and ask("'1.0', NULL, NULL, NULL") and ask("'junk', '0', NULL, NULL") is None


def test_facts_over_a_table(registered):
    registered.createDataFrame([(1, "import a\n"), (2, "def broken(:"), (3, None)], "id int, content string").createOrReplaceTempView("sources")
    rows = registered.sql("SELECT id, kind, base, name FROM source_facts(TABLE(sources))").collect()
    assert {(r.id, r.kind) for r in rows} == {(1, "file"), (1, "use"), (1, "bind"), (2, "unparsed"), (3, "file")}
    with pytest.raises(Exception, match="content"):
        registered.sql("SELECT * FROM source_facts(TABLE(SELECT 1 AS a))").collect()
    with pytest.raises(Exception, match="rename the columns kind"):
        registered.sql("SELECT * FROM source_facts(TABLE(SELECT 1 AS kind, '' AS content))").collect()
