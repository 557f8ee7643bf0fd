"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str, name: str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return (F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)).alias(name)


def sql6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


class Registered(dict):
    """name -> (query, SQL or None), filled by the decorator."""

    def query(self, sql: str | None = None):
        def add(f):
            self[f.__name__] = (f, sql)
            return f

        return add
