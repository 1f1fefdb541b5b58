"""Runtime call events folded to the functions that ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_function_call(event: Column, module: Column, func: Column) -> Column:
    """Call events of named functions; of the synthetic names only ``<module>``."""
    named = ~func.startswith("<") | (func == "<module>")
    return (event == "call") & named & (F.coalesce(module, F.lit("")) != "")


def fold_calls(events: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys, module, func`` of call events (batch or stream)."""
    kept = events.where(is_function_call(F.col("event"), F.col("module"), F.col("func")))
    return kept.select(*keys, "module", "func").dropDuplicates()


def load_trace(raw: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """``keys, module, func`` from trace texts ``{module: [function, ...]}``.

    A text that is not such an object gives no rows.
    """
    doc = F.from_json(F.col(content), "MAP<STRING, ARRAY<STRING>>")
    modules = raw.select(*keys, F.explode(doc).alias("module", "funcs"))
    return modules.select(*keys, "module", F.explode("funcs").alias("func")).distinct()


def trace_documents(calls: DataFrame, *keys: str) -> DataFrame:
    """``keys, module, functions``: sorted function lists, as a trace file holds them."""
    return calls.groupBy(*keys, "module").agg(F.array_sort(F.collect_set("func")).alias("functions"))
