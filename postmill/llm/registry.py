"""All queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import abuse, boilerplate, canon, language, leak, mixing, mojibake, neardup, pii, truncation

MODULES = (canon, truncation, neardup, pii, boilerplate, language, abuse, leak, mixing, mojibake)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
