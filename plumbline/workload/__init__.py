"""The operators applied to the benchmark tables, each with its check in SQL."""

from plumbline.workload import coverage, folders, graphs, live, matching, reports, scoring, sqltext, texts

MODULES = (matching, scoring, graphs, texts, reports, coverage, live, folders, sqltext)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
