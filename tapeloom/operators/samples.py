"""Sample assembly: trailing windows per week end as rows, training rows, named scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import finite
from tapeloom.operators.labels import next_week_ord
from tapeloom.sources.upsert import with_dimension

WINDOW = 50


def tail_windows(panel: DataFrame, weeks: DataFrame, columns: Sequence[str], length: int = WINDOW) -> DataFrame:
    """The last ``length`` rows of each entity at each week end, as rows with ``t_pos`` 0..length-1.

    A row belongs to every week end between its own date and the date that
    pushes it out of the window, which is one lead away, so rows are expanded
    where they are: no range join, one shuffle by entity. Entities with fewer
    rows have no sample.
    """
    w = Window.partitionBy("entity").orderBy("date")
    rows = panel.select(
        "entity",
        "date",
        *columns,
        F.row_number().over(w).alias("_row"),
        F.lead("date", length).over(w).alias("_out"),
        F.collect_list("date").over(w.rowsBetween(Window.currentRow, length - 1)).alias("_next"),
    )
    days = panel.select("date").distinct()
    first_at = next_week_ord(days, weeks)
    last = weeks.agg(F.max("week_ord").alias("_last"))
    spans = (
        rows.join(F.broadcast(first_at.toDF("date", "_from")), "date")
        .join(F.broadcast(first_at.toDF("_out", "_until")), "_out", "left")
        .join(F.broadcast(last), F.lit(True))
        .withColumn("_to", F.coalesce(F.col("_until") - 1, F.col("_last")))
        .where("_from <= _to")
    )
    at_week = spans.withColumn("week_ord", F.explode(F.sequence("_from", "_to"))).join(
        F.broadcast(weeks.select("week_ord", F.col("date").alias("sample_date"))), "week_ord"
    )
    since = F.size(F.filter("_next", lambda d: d <= F.col("sample_date"))) - 1
    placed = at_week.withColumn("_since", since).where(F.col("_row") + F.col("_since") >= length)
    return placed.select("sample_date", "entity", (length - 1 - F.col("_since")).alias("t_pos"), *columns)


def training_rows(features: DataFrame, labels: DataFrame, universe: DataFrame | None = None,
                  industry: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """Features with labels, optionally restricted to a universe, with industry id and context.

    An unknown industry gets the next free id; a date without context gets 0.
    Context holds one row per week and is broadcast.
    """
    keys = ["sample_date", "entity"]
    df = features.join(labels, keys)
    if universe is not None:
        df = df.join(universe.select(F.col("date").alias("sample_date"), "entity"), keys, "left_semi")
    if industry is not None:
        df = with_dimension(df, industry)
    if context is not None:
        ctx = context.withColumnRenamed("date", "sample_date")
        df = df.join(F.broadcast(ctx), "sample_date", "left").fillna(0.0, [c for c in ctx.columns if c != "sample_date"])
    return df


def model_rows(features: DataFrame, labels: DataFrame, universe: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """``sample_date, entity, features`` with the label, for training and scoring.

    Samples outside the universe go, those without a label stay with a null. The context of the date (one row per week)
    is appended to the features; missing values and dates count as 0.
    """
    keys = ["sample_date", "entity"]
    df = features.join(labels.select(*keys, "next_week_return"), keys, "left")
    if universe is not None:
        df = df.join(universe.select(F.col("date").alias("sample_date"), "entity"), keys, "left_semi")
    if context is not None:
        names = [c for c in context.columns if c != "date"]
        row = F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in names])
        weekly = context.select(F.col("date").alias("sample_date"), row.alias("_context"))
        none = F.array_repeat(F.lit(0.0), len(names))
        df = df.join(F.broadcast(weekly), "sample_date", "left").withColumn(
            "features", F.concat("features", F.coalesce("_context", none))).drop("_context")
    return df


def scored_with_names(scores: DataFrame, master: DataFrame, day) -> DataFrame:
    """One day's scores with names from the stock master."""
    return scores.where(F.col("date") == F.lit(day).cast("date")).join(master, "entity")
