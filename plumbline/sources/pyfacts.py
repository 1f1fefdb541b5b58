"""One pass over Python source files that yields syntactic facts as rows.

The per-file helper only reads syntax. Everything that needs more than one file
(whose import is first-party, which call resolves where, what is reachable) is
done with joins in ``plumbline.operators``.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT_COLUMNS = (
    "kind string, owner string, owner_ix int, cls string, base string, name string, "
    "raw_base string, raw_name string, level int, line int, end_line int, ix int, bind_base string, bind_name string"
)
# kind    meaning of the columns
# file    the file parsed
# unparsed  a file that is no valid Python; ``name`` says why
# use     imported top module ``base``, optional symbol ``name`` (any depth)
# attr    attribute ``name`` used on a name bound to top module ``base``
# bind    module-level import: local ``raw_name``; ``base`` module, ``name`` symbol
# def     function ``owner`` (``owner_ix`` numbers it), short ``name``, lines
# class   class ``owner``, lines
# call    call in ``owner``: ``base.name`` with one-hop aliases replaced; ``raw_*``
#         is the text as written. If its first name is bound by an import at module level,
#         ``level``, ``bind_base`` and ``bind_name`` are those of the last such ``bind``
# dynimp  constant dynamic import of top module ``name`` in ``owner``
# inner   function short name ``base`` contains a call of short name ``name``


def _target(node: ast.expr) -> tuple[str | None, str] | None:
    if type(node) is ast.Name:
        return None, node.id
    if type(node) is ast.Attribute and type(node.value) is ast.Name:
        return node.value.id, node.attr
    return None


# Fields that never hold a node which says something here: texts, numbers, load or store, operators.
_PLAIN = {
    "ctx", "op", "ops", "id", "attr", "arg", "module", "level", "asname", "kind", "type_comment", "simple", "conversion", "is_async", "rest", "tag",
}
_LEAVES = (ast.Name, ast.Constant)


def _fields(kind: type) -> tuple[str, ...]:
    if kind in (*_LEAVES, ast.Import, ast.ImportFrom):
        return ()
    return tuple(f for f in kind._fields if f not in _PLAIN)


class _Facts:
    """One walk over a syntax tree; rows are tuples in the order of ``FACT_COLUMNS``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.scope: list[tuple[str, bool]] = []  # (name, is a function)
        self.owner, self.owner_ix, self.cls = "", 0, None
        self.aliases: dict[str, tuple[str | None, str]] = {}
        self.defs = 0
        self.imports: list[tuple[int, ast.stmt]] = []  # (depth, statement)
        self.attributes: set[tuple[str, str]] = set()
        self.calls: list[tuple[int, str]] = []  # (place among the rows, first name)

    def add(self, kind, owner=None, owner_ix=None, cls=None, base=None, name=None, raw_base=None, raw_name=None, level=None, line=None, end_line=None) -> None:
        self.rows.append((kind, owner, owner_ix, cls, base, name, raw_base, raw_name, level, line, end_line, len(self.rows), None, None))

    def below(self, node: ast.AST, depth: int) -> None:
        """Visits the nodes right below, in order."""
        kind = type(node)
        fields = _FIELDS.get(kind)
        if fields is None:
            fields = _FIELDS[kind] = _fields(kind)
        depth += 1
        for field in fields:
            value = getattr(node, field, None)
            if not value:
                continue
            for child in value if type(value) is list else (value,):
                step = _STEPS.get(type(child))
                if step is not None:
                    step(self, child, depth)
                elif isinstance(child, ast.AST) and not isinstance(child, _LEAVES):
                    self.below(child, depth)

    def definition(self, node, depth: int) -> None:
        is_function = type(node) is not ast.ClassDef
        kept = self.owner, self.owner_ix, self.cls, self.aliases
        self.scope.append((node.name, is_function))
        qualified = ".".join([name for name, _ in self.scope])
        first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        if is_function:
            self.defs += 1
            self.owner, self.owner_ix, self.aliases = qualified, self.defs, {}
            self.add("def", qualified, self.defs, self.cls, None, node.name, None, None, None, first, node.end_lineno)
        else:
            self.add("class", qualified, None, self.cls, None, node.name, None, None, None, first, node.end_lineno)
            self.cls = node.name
        self.below(node, depth)
        self.scope.pop()
        self.owner, self.owner_ix, self.cls, self.aliases = kept

    def assignment(self, node: ast.Assign, depth: int) -> None:
        if len(node.targets) == 1 and type(node.targets[0]) is ast.Name:
            target = _target(node.value)
            if target:
                self.aliases[node.targets[0].id] = target
        self.below(node, depth)

    def call(self, node: ast.Call, depth: int) -> None:
        short = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
        if short and self.scope:
            for outer in {name for name, is_function in self.scope if is_function} - {short}:
                self.add("inner", base=outer, name=short)
        target = _target(node.func)
        if target:
            base, name = target
            dynamic = (base is None and name == "__import__") or (base and name == "import_module")
            first = node.args[0] if node.args else None
            if dynamic and isinstance(first, ast.Constant) and isinstance(first.value, str):
                self.add("dynimp", self.owner, self.owner_ix, name=first.value.split(".")[0])
            seen = self.aliases.get(name, (None, name)) if base is None else (base, name)
            self.calls.append((len(self.rows), seen[0] or seen[1]))
            self.add("call", self.owner, self.owner_ix, self.cls, seen[0], seen[1], base, name)
        self.below(node, depth)

    def attribute(self, node: ast.Attribute, depth: int) -> None:
        if type(node.value) is ast.Name:
            self.attributes.add((node.value.id, node.attr))
        else:
            self.below(node, depth)

    def statement(self, node: ast.stmt, depth: int) -> None:
        self.imports.append((depth, node))

    def import_rows(self) -> None:
        bound: dict[str, str] = {}
        self.imports.sort(key=lambda found: found[0])  # level by level, as ast.walk
        for _, node in self.imports:
            if type(node) is ast.Import:
                for item in node.names:
                    top = item.name.split(".")[0]
                    bound[item.asname or top] = top
                    self.add("use", base=top)
            elif not node.level and node.module:
                top = node.module.split(".")[0]
                self.add("use", base=top)
                for item in node.names:
                    if item.name != "*":
                        self.add("use", base=top, name=item.name)
        used = {(bound[name], attr) for name, attr in self.attributes if name in bound}
        for top, attr in sorted(used):
            self.add("attr", base=top, name=attr)
        last: dict[str, tuple[int, str | None, str | None]] = {}
        for depth, node in self.imports:
            if depth > 1:
                break
            for item in node.names:
                if type(node) is ast.Import:
                    local, base, name, level = item.asname or item.name.split(".")[0], item.name, None, 0
                else:
                    local, base, name, level = item.asname or item.name, node.module, item.name, node.level
                self.add("bind", base=base, name=name, raw_name=local, level=level)
                last[local] = (level, base, name)
        for at, local in self.calls:
            if local in last:
                level, base, name = last[local]
                row = self.rows[at]
                self.rows[at] = (*row[:8], level, *row[9:12], base, name)


_FIELDS: dict[type, tuple[str, ...]] = {}
_STEPS = {
    ast.FunctionDef: _Facts.definition,
    ast.AsyncFunctionDef: _Facts.definition,
    ast.ClassDef: _Facts.definition,
    ast.Assign: _Facts.assignment,
    ast.Call: _Facts.call,
    ast.Attribute: _Facts.attribute,
    ast.Import: _Facts.statement,
    ast.ImportFrom: _Facts.statement,
    ast.Name: lambda facts, node, depth: None,
    ast.Constant: lambda facts, node, depth: None,
}


def fact_rows(source: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Facts of one file; one that cannot be parsed has a single row that says so.

    With ``kinds``, only facts of these kinds.
    """
    try:
        tree = ast.parse(source)
        facts = _Facts()
        facts.add("file")
        facts.below(tree, 0)
        facts.import_rows()
    except (SyntaxError, ValueError, RecursionError) as problem:
        facts = _Facts()
        facts.add("unparsed", name=type(problem).__name__)
    return facts.rows if kinds is None else [row for row in facts.rows if row[0] in kinds]


_NAMES = [part.split()[0] for part in FACT_COLUMNS.split(", ")]


def file_facts(source: str) -> list[dict]:
    """As ``fact_rows``, each row as what it says by name."""
    return [{name: value for name, value in zip(_NAMES, row) if value is not None} for row in fact_rows(source)]


def source_facts(files: DataFrame, *carry: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of all ``files`` (needs ``content``), with the ``carry`` columns.

    Every file is parsed and walked; with ``kinds`` only rows of these kinds leave the tasks.
    """
    asked = None if kinds is None else frozenset(kinds)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*carry).schema)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in files.select(*carry).schema]
    fields += [(part.split()[0], kinds[part.split()[1]]) for part in FACT_COLUMNS.split(", ")]
    shape = pa.schema(fields)

    def made(kept_columns: list[list], rows: list[tuple]) -> pa.RecordBatch:
        columns = [*kept_columns, *zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column by column: facts of a few files at a time become one batch."""
        # Trees and rows hold no cycles: looking for some costs a third of the time and frees nothing.
        gc.disable()
        try:
            yield from extracted(batches)
        finally:
            gc.enable()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept_columns, contents = [c.to_pylist() for c in batch.columns]
            carried: list[list] = [[] for _ in kept_columns]
            rows: list[tuple] = []
            for at, content in enumerate(contents):
                facts = fact_rows(content or "", asked)
                rows += facts
                for column, values in zip(carried, kept_columns):
                    column.extend([values[at]] * len(facts))
                if len(rows) > 20_000:
                    yield made(carried, rows)
                    carried, rows = [[] for _ in kept_columns], []
            if rows:
                yield made(carried, rows)

    return files.select(*carry, "content").mapInArrow(extract, f"{kept}, {FACT_COLUMNS}")


def shared_facts(files: DataFrame, *carry: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """As ``source_facts``, for files that many projects have: each distinct text is parsed once.

    Copies of a text collapse in the tasks that hold them before they are
    shuffled; the facts then go back to the files by the text's digest.
    """
    keyed = files.withColumn("content_id", F.md5(F.coalesce("content", F.lit(""))))
    texts = keyed.groupBy("content_id").agg(F.first("content").alias("content"))
    facts = source_facts(texts, "content_id", kinds=kinds)
    return keyed.select(*carry, "content_id").join(facts, "content_id").drop("content_id")
