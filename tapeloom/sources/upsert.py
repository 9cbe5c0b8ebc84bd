"""Incremental ingest: union, newest row wins, high-water marks.

A key may repeat any number of times, so the newest row is picked by an
aggregate that combines map-side; no task ever holds all copies of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.crosssection import text_positions


def newest(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One whole row per key: the one with the greatest ``order``."""
    order = F.col(order) if isinstance(order, str) else order
    values = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert(old: DataFrame | None, new: DataFrame | None, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """Union of both column sets with one row per key; rows of ``new`` replace rows of ``old``.

    Rows that repeat a key inside one side are told apart by their content, so
    the result does not depend on row order.
    """
    sides = [s for s in (old, new) if s is not None]
    if not sides:
        raise ValueError("nothing to write")
    staged = [s.withColumn("_batch", F.lit(i)) for i, s in enumerate(sides)]
    both = staged[0]
    for other in staged[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys and c != "_batch"]
    return newest(both, keys, F.struct("_batch", *values)).drop("_batch")


def upsert_flags(old: DataFrame, new: DataFrame, value: str = "flag") -> DataFrame:
    """Long flag matrices: a cell of ``new`` wins unless it is NULL."""
    keys = ["date", "entity"]
    joined = old.withColumnRenamed(value, "_old").join(new.withColumnRenamed(value, "_new"), keys, "full")
    return joined.select(*keys, F.coalesce("_new", "_old").alias(value))


def high_water_mark(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(date).alias("mark"))


def since_mark(new: DataFrame, stored: DataFrame, date: str = "date") -> DataFrame:
    """Rows from the stored high-water mark on, that day included, so it is revised."""
    mark = high_water_mark(stored, date)
    return new.join(F.broadcast(mark), F.col("mark").isNull() | (F.col(date) >= F.col("mark"))).drop("mark")


def upsert_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Calendar upsert: distinct days of both."""
    return old.select("date").union(new.select("date")).distinct()


def snapshot_master(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Projection of a vendor export: ``{source column: target column}``."""
    return df.select(*[F.col(f"`{source}`").alias(target) for source, target in names.items()])


def dimension_ids(df: DataFrame, key: str = "entity", name: str = "name", order: str | None = None) -> DataFrame:
    """Key to dense id by sorted name; trimmed, NULLs dropped, first row per key wins.

    ``order`` names a column that says which row of a key is first; without it
    the smallest name is taken.
    """
    clean = df.withColumns({key: F.trim(key), name: F.trim(name)}).where(
        F.col(key).isNotNull() & F.col(name).isNotNull()
    )
    first = clean.groupBy(key).agg(F.min_by(name, F.col(order or name)).alias(name))
    return first.join(dense_ids(first, name), name).select(key, name, "id")


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Distinct names with ids 0..K-1 in sorted order."""
    return text_positions(df.select(name).distinct(), name, "id")


def with_dimension(df: DataFrame, ids: DataFrame, key: str = "entity", out: str = "industry_id") -> DataFrame:
    """Attach ids; unknown keys get the next free id."""
    pad = ids.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("_pad"))
    known = ids.select(key, F.col("id").alias(out))
    return (
        df.join(known, key, "left")
        .join(F.broadcast(pad), F.lit(True))
        .withColumn(out, F.coalesce(F.col(out), F.col("_pad")))
        .drop("_pad")
    )
