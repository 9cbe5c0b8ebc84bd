"""Data-quality checks of stored samples, labels and context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalogue(store: DataFrame, keys: Sequence[str] = ("sample_date", "entity")) -> DataFrame:
    """Stored sample dates with their number of entities and the width of the store."""
    width = len([c for c in store.columns if c not in keys])
    return store.groupBy("sample_date").agg(
        F.count_distinct("entity").alias("n_entities"), F.lit(width).cast("long").alias("n_factors")
    )


def store_audit(store: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """Per sample date: samples, samples with a window of another length and rows that repeat a sample."""
    wrong = reduce(or_, [F.size(c) != length for c in columns])
    per = store.groupBy("sample_date", "entity").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(wrong).alias("wrong"))
    return per.groupBy("sample_date").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if("wrong").alias("n_wrong_length"),
        F.sum(F.col("rows") - 1).alias("n_duplicates"),
    )


def missing_counts(packed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells, and NULL, NaN and infinite ones, per array column, all in one pass."""
    def cells(c: str, bad) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(c, bad))), F.lit(0)).cast("long")

    stats = F.array(*[F.struct(
        F.lit(c).alias("name"), F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias("n_rows"), cells(c, lambda x: x.isNull()).alias("n_null"),
        cells(c, F.isnan).alias("n_nan"), cells(c, lambda x: F.abs(x) == float("inf")).alias("n_inf")) for c in columns])
    return packed.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def date_sets(features: DataFrame, labels: DataFrame, context: DataFrame) -> DataFrame:
    """Every date of three stores with where it occurs and the set it falls in."""
    tagged = None
    for name, df in (("features", features), ("labels", labels), ("context", context)):
        one = df.select("date", F.lit(name).alias("store"))
        tagged = one if tagged is None else tagged.union(one)
    seen = tagged.groupBy("date").agg(*[
        F.bool_or(F.col("store") == s).alias(f"in_{s}") for s in ("features", "labels", "context")
    ])
    f, l, c = (F.col(f"in_{s}") for s in ("features", "labels", "context"))
    group = (
        F.when(f & l & c, "all").when(f & ~l & ~c, "features_only").when(f & ~l, "no_label").when(f & ~c, "no_context")
    )
    return seen.withColumn("set", group.otherwise("no_features"))


def effective_samples(samples: DataFrame, labels: DataFrame, dates: DataFrame) -> DataFrame:
    """Labelled samples per date; dates without any report 0."""
    keys = ["sample_date", "entity"]
    counted = samples.select(*keys).distinct().join(labels.select(*keys), keys, "left_semi").groupBy("sample_date").agg(
        F.count(F.lit(1)).alias("n_effective")
    )
    return dates.select(F.col("date").alias("sample_date")).join(counted, "sample_date", "left").fillna(0, ["n_effective"])


def map_coverage(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Share of distinct entities that the mapping knows."""
    names = entities.select("entity").distinct()
    known = mapping.select("entity").distinct().withColumn("_known", F.lit(1))
    return names.join(known, "entity", "left").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count("_known").alias("n_covered"),
        (F.count("_known") / F.count(F.lit(1))).alias("covered_ratio"),
    )


def unmapped(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    return entities.select("entity").distinct().join(mapping, "entity", "left_anti")


def contract_check(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows, duplicate keys and the share of missing values; a missing column is an error."""
    lacking = {*keys, *values} - set(df.columns)
    if lacking:
        raise ValueError(f"missing columns {sorted(lacking)}")
    absent = F.lit(0)
    for v in values:
        absent = absent + F.when(F.col(v).isNull() | F.isnan(v), 1).otherwise(0)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(absent).alias("absent"))
    rows = F.sum("n")
    return per_key.agg(
        rows.alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_duplicate_rows"),
        (F.sum("absent") / (rows * len(values))).alias("missing_ratio"),
    )
