"""The queries of the engine and, for each that SQL can express, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

from . import chats, consensus, files, linking, pages, profiles, routing, text  # noqa: E402

for part in (text, profiles, routing, chats, consensus, pages, linking, files):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
