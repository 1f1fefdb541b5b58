"""Version order and source facts for SQL text.

``register`` adds temporary functions to a session: ``version_key(v)`` and
``version_between(v, introduced, fixed, last_affected)``, which Spark inlines as
expressions, and the table function ``source_facts(TABLE(...))``, which parses the
Python text in ``content`` and passes every other column on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plumbline.functions.versions import DEV, DEV_N, EPOCH, LOCAL, PEP440, POST, POST_BARE, POST_N, PRE, PRE_N, RELEASE
from plumbline.sources.pyfacts import FACT_COLUMNS, file_facts


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(digits: str) -> str:
    bare = f"trim(LEADING '0' FROM {digits})"
    return f"concat(lpad(CAST(length({bare}) AS STRING), 4, '0'), {bare})"


def _key_text() -> str:
    """The key of ``functions.versions.version_key`` as SQL text; a test holds the two together."""
    g = lambda i: f"g[{i}]"
    groups = "concat(" + ", ".join(f"'\\u0001${i}'" for i in range(1, 11)) + ")"
    split = f"CASE WHEN startswith(r, '\\u0001') AND NOT contains(v, '\\u0001') THEN split(r, '\\u0001', -1) END"
    parts = f"array_join(transform(split(t, r'\\.'), p -> concat('1', {_number('p')})), '')"
    zeros = f"regexp_replace({g(RELEASE)}, r'(?:^|\\.)0+(?:\\.0+)*$', '')"
    release = f"concat({_let(zeros, 't', f'''CASE WHEN t = '' THEN '' ELSE {parts} END''')}, '0')"
    tag = f"lower({g(PRE)})"
    code = f"CASE WHEN {tag} LIKE 'a%' THEN 'a' WHEN {tag} LIKE 'b%' THEN 'b' ELSE 'r' END"
    has_post = f"({g(POST)} <> '' OR {g(POST_BARE)} <> '')"
    pre = f"CASE WHEN {tag} <> '' THEN concat('1', {code}, {_number(g(PRE_N))}) WHEN NOT {has_post} AND {g(DEV)} <> '' THEN '0' ELSE '2' END"
    post = f"CASE WHEN {has_post} THEN concat('1', {_number(f'concat({g(POST_BARE)}, {g(POST_N)})')}) ELSE '0' END"
    dev = f"CASE WHEN {g(DEV)} <> '' THEN concat('0', {_number(g(DEV_N))}) ELSE '1' END"
    label = f"CASE WHEN s RLIKE '^[0-9]+$' THEN concat('11', {_number('s')}) ELSE concat('10', s, '!') END"
    local = f"CASE WHEN {g(LOCAL)} <> '' THEN concat('1', array_join(transform(split(lower({g(LOCAL)}), '[._-]'), s -> {label}), ''), '0') ELSE '0' END"
    whole = f"CASE WHEN g IS NOT NULL THEN concat({_number(g(EPOCH))}, {release}, {pre}, {post}, {dev}, {local}) END"
    return _let(_let(f"regexp_replace(v, r'{PEP440}', {groups})", "r", split), "g", whole)


FACTS = [StructField(name, IntegerType() if kind == "int" else StringType()) for name, kind in (part.split() for part in FACT_COLUMNS.split(", "))]


class SourceFacts:
    """Table function over a table with ``content``; a text that is NULL counts as empty."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "content" not in table.dataType.fieldNames():
            raise ValueError("source_facts wants TABLE(...) with a column named content")
        carried = [f for f in table.dataType.fields if f.name != "content"]
        clash = sorted({f.name for f in carried} & {f.name for f in FACTS})
        if clash:
            raise ValueError(f"rename the columns {', '.join(clash)}: facts have columns of that name")
        return AnalyzeResult(StructType(carried + FACTS))

    def eval(self, row: Row) -> Iterator[tuple]:
        values = row.asDict()
        content = values.pop("content")
        for fact in file_facts(content or ""):
            yield (*values.values(), *(fact.get(f.name) for f in FACTS))


def register(spark: SparkSession) -> None:
    """Adds the functions to the session; call it once before SQL that uses them."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION version_key(v STRING) RETURNS STRING RETURN {_key_text()}")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION version_between(v STRING, introduced STRING, fixed STRING, last_affected STRING) RETURNS BOOLEAN
        RETURN version_key(v) >= coalesce(version_key(introduced), '')
          AND (fixed IS NULL OR version_key(v) < version_key(fixed))
          AND (last_affected IS NULL OR version_key(v) <= version_key(last_affected))
    """)
    spark.udtf.register("source_facts", udtf(SourceFacts))
