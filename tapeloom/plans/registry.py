"""The query registry: each entry pairs a Spark query with its SQL check."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType

from tapeloom.functions.scalars import reported

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; without ``sql`` only its rows are checked."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def report(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """All double columns at reporting precision (see :func:`reported`)."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({n: reported(n, special.get(n, digits)) for n in doubles})


def final(inner: str, keys: str, doubles: str | Iterable[str], digits: int = 9, **special: int) -> str:
    """The SQL side of :func:`report`: a SELECT over the named relation or subquery."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    cells = [
        f"CAST(CAST(round({n}, {special.get(n, digits)}) AS FLOAT) AS DOUBLE) + 0.0 AS {n}" for n in names
    ]
    source = inner if inner.replace("_", "").isalnum() else f"({inner}) AS _x"
    return f"SELECT {', '.join([k for k in [keys] if k] + cells)} FROM {source}"
