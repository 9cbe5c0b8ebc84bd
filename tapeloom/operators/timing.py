"""Timing overlay: next-day label, rolling classifier, and the cost of switching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeloom.session import cut_lineage


def next_day_label(features: DataFrame, threshold: float = -0.03, keys: Sequence[str] = ()) -> DataFrame:
    """1 if tomorrow's return exceeds ``threshold``; the last day is dropped."""
    following = F.lead("ret_total").over(Window.partitionBy(*keys).orderBy("date"))
    return features.withColumn("ret_next", following).where("ret_next IS NOT NULL").withColumn(
        "y", (F.col("ret_next") > threshold).cast("int")
    )


def rolling_folds(rows: DataFrame, train: int = 252, step: int = 21, keys: Sequence[str] = ()) -> DataFrame:
    """Each row once per fold it serves: ``role`` train or predict.

    Fold k predicts rows ``train + k*step`` onwards and trains on the ``train``
    rows before them; a row reaches at most ``train/step + 1`` folds.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    n = F.row_number().over(w) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = rows.withColumns({"_i": n, "_total": total})
    first = F.greatest(F.ceil((F.col("_i") - train - step + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_total") - train - 1) / step))
    spread = placed.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    start = F.col("fold") * step + train
    role = (
        F.when((F.col("_i") >= start - train) & (F.col("_i") < start), "train")
        .when((F.col("_i") >= start) & (F.col("_i") < start + step), "predict")
    )
    return spread.withColumn("role", role).where("role IS NOT NULL").drop("_i", "_total")


def scale_by_fold(folds: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Standardise each fold with the moments of its training rows; constant columns become 0."""
    by = [*keys, "fold"]
    moments = [a for c in columns for a in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]
    fitted = folds.where("role = 'train'").groupBy(*by).agg(*moments)
    joined = folds.join(fitted, by)
    z = {c: F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(0.0) for c in columns}
    return joined.withColumns(z).select(*folds.columns)


def _newton_step(batches: Iterator[pd.DataFrame], width: int, penalty: float) -> Iterator[pd.DataFrame]:
    """Adds the Newton step of every fold to its weights; a fold is one row of sums."""
    ridge = np.eye(width) * penalty
    ridge[0, 0] = 0.0
    for batch in batches:
        weights, steps = [], []
        for sums, w in zip(batch["sums"], batch["w"]):
            gram, slope = sums[: width * width].reshape(width, width), sums[width * width:]
            step = np.linalg.lstsq(gram + ridge, slope - ridge @ w, rcond=None)[0]
            weights.append(w + step)
            steps.append(float(np.abs(step).max()))
        yield batch.drop(columns=["sums", "w", "step"]).assign(w=weights, step=steps)


def fit_logistic(rows: DataFrame, by: Sequence[str], width: int, penalty: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """``by, w``: weights of an L2-penalised logistic model per group of rows (``x`` with a leading 1, ``y``).

    Iteratively reweighted least squares: one aggregation per round adds up the weighted products and the slope of every
    group, map-side first, so a group's rows need not meet. All groups advance in the same jobs until no weight moves by
    ``tolerance``. The intercept is not penalised. Groups with one class are left out.
    """
    by = list(by)
    both = rows.groupBy(*by).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi")).where("_lo < _hi")
    weights = cut_lineage(both.select(*by, F.array_repeat(F.lit(0.0), width).alias("w"), F.lit(1.0).alias("step")))
    kind = StructType([*weights.schema.fields])
    for _ in range(rounds):
        z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))
        judged = rows.join(weights.select(*by, "w"), by).withColumn("p", p).withColumn("v", F.col("p") * (1 - F.col("p")))
        products = F.flatten(F.transform("x", lambda a: F.transform(F.col("x"), lambda b: a * b * F.col("v"))))
        cells = F.concat(products, F.transform("x", lambda a: a * (F.col("y") - F.col("p"))))
        sums = judged.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector(cells))).alias("sums"))
        moved = sums.join(weights, by).select(*by, "w", "step", "sums").mapInPandas(lambda it: _newton_step(it, width, penalty), kind)
        weights = cut_lineage(moved)
        if (weights.agg(F.max("step")).first()[0] or 0.0) < tolerance:
            break
    return weights.select(*by, "w")


def rolling_signals(labelled: DataFrame, columns: Sequence[str], train: int = 252, step: int = 21, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, fold, date, p, signal``: daily in/out signal of each series from a logistic model refitted every ``step`` days.

    Rows are spread to their folds, scaled with window aggregates, and all folds of all series are fitted by the same
    jobs. A training window with one class predicts that class.
    """
    by = [*keys, "fold"]
    placed = rolling_folds(labelled.select(*keys, "date", "y", *columns), train, step, keys)
    folds = scale_by_fold(placed, columns, keys)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    rows = cut_lineage(folds.select(*by, "date", "role", F.col("y").cast("double").alias("y"), x.alias("x")))
    past, ahead = rows.where("role = 'train'"), rows.where("role = 'predict'")
    weights = fit_logistic(past, by, len(columns) + 1)
    only = past.groupBy(*by).agg(F.min("y").alias("_y"))
    z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    p = F.when(F.col("w").isNull(), F.col("_y")).otherwise(1.0 / (1.0 + F.exp(-z)))
    judged = ahead.join(only, by).join(weights, by, "left").withColumn("p", p)
    return judged.select(*by, "date", "p", (F.col("p") > 0.5).cast("int").alias("signal"))


def overlay(nav: DataFrame, signals: DataFrame, buy: float = 0.001, sell: float = 0.001, keys: Sequence[str] = ()) -> DataFrame:
    """Hold the strategy only when yesterday's signal says so, paying to switch; each series (``keys``) on its own.

    A day without a signal counts as in. Leaving is charged on the day of the
    decision, entering on the day after it.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    df = nav.select(*keys, "date", F.col("ret_total").alias("ret_total_prev"), F.col("nav").alias("nav_prev"))
    df = df.join(signals.select(*keys, "date", "signal"), [*keys, "date"], "left").withColumn("signal", F.coalesce("signal", F.lit(1)))
    df = df.withColumns({"_s1": F.lag("signal", 1).over(w), "_s2": F.lag("signal", 2).over(w)})
    df = df.withColumn("signal_prev", F.coalesce("_s1", "signal"))
    leave = F.when((F.col("_s1") == 1) & (F.col("signal") == 0), F.lit(-sell)).otherwise(0.0)
    enter = F.when((F.col("_s2") == 0) & (F.col("_s1") == 1), F.lit(-buy)).otherwise(0.0)
    held = F.when(F.col("signal_prev") == 1, F.col("ret_total_prev")).otherwise(0.0)
    df = df.withColumn("ret_total", held + leave + enter)
    grown = F.product(1 + F.col("ret_total")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("nav", grown).select(*keys, "date", "ret_total_prev", "nav_prev", "signal", "signal_prev", "ret_total", "nav")
