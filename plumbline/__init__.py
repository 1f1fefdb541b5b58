"""Software-composition analysis on Spark: match, reach, score, rank, report."""

__version__ = "0.1.0"
TOOL_NAME = "plumbline"
