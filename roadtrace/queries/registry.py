"""Named queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = ""):
    """Register a function (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if prelude:
                text = prelude.rstrip() + (",\n" + text[4:].lstrip() if text[:5].upper() == "WITH " else "\n" + text)
            ORACLES[f.__name__] = text
        return f

    return add
