"""Ridge for every window of a walk-forward schedule, from moments of blocks of weeks.

A moment matrix holds the sums of products of ``1, features, label`` over some rows. Such sums add up, so they are formed
once per block of weeks between two borders of any window, and a window's matrix is the sum of its blocks; no row is read
twice, however much windows overlap. What meets in a task depends on the number of features and weeks, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a matrix that travel together, and blocks whose matrices a task holds before it hands them on.
STRIP, HELD = 64, 8
MODEL = "window_id long, alpha double, n long, intercept double, coefficients array<double>"


def train_borders(plan: DataFrame) -> pd.DataFrame:
    """``window_id, first, last``: the training weeks of each window; one row per window."""
    return plan.where("role = 'train'").groupBy("window_id").agg(
        F.min("week_ord").alias("first"), F.max("week_ord").alias("last")).orderBy("window_id").toPandas()


def block_moments(rows: DataFrame, cuts: Sequence[int], shift: np.ndarray, label: str) -> DataFrame:
    """``block, strip, sums``: strips of the moment matrix of every block of weeks; ``cuts`` are the blocks' first weeks.

    ``shift`` is taken from the features first, which keeps the sums well-conditioned. Tasks add the rows of a batch at
    once and hand on partial strips; these are added as vectors, map-side first.
    """
    firsts = np.array(sorted(cuts))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def strips() -> pd.DataFrame:
            return pd.DataFrame([(b, i, m[i * STRIP: (i + 1) * STRIP].ravel()) for b, m in held.items() for i in range(-(-len(m) // STRIP))],
                                columns=["block", "strip", "sums"])

        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["features"].to_numpy()) - shift
            z = np.column_stack([np.ones(len(x)), x, batch[label].to_numpy(float)])
            blocks = np.searchsorted(firsts, batch["week_ord"].to_numpy(), "right") - 1
            for b in np.unique(blocks).tolist():
                own = z[blocks == b]
                held[b] = held[b] + own.T @ own if b in held else own.T @ own
            if len(held) > HELD:
                yield strips()
                held.clear()
        if held:
            yield strips()

    parts = rows.select("week_ord", "features", label).mapInPandas(partial, "block long, strip long, sums array<double>")
    return parts.select("block", "strip", array_to_vector("sums").alias("v")).groupBy("block", "strip").agg(
        vector_to_array(Summarizer.sum(F.col("v"))).alias("sums"))


def solve(matrix: np.ndarray, shift: np.ndarray, alpha: float) -> tuple[int, float, np.ndarray]:
    """Rows, intercept and coefficients of a ridge on features divided by their population deviation, not centred.

    A feature without spread is divided by 1. The intercept is not penalised.
    """
    n = matrix[0, 0]
    mean, y = matrix[0, 1:-1] / n, matrix[0, -1] / n
    products = matrix[1:-1, 1:-1] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(products) / n, 0.0))
    # What rounding leaves of a constant is no spread.
    spread = np.where(spread > 1e-9 * (1.0 + np.abs(mean + shift)), spread, 1.0)
    gram = products / np.outer(spread, spread)
    right = (matrix[1:-1, -1] - n * mean * y) / spread
    weights = np.linalg.solve(gram + alpha * np.eye(len(gram)), right) / spread
    return int(round(n)), float(y - weights @ (mean + shift)), weights


def fit_ridges(samples: DataFrame, plan: DataFrame, alphas: Sequence[float] = (1.0,), label: str = "next_week_return") -> DataFrame:
    """:data:`MODEL`: one row per window and penalty.

    ``samples`` has ``sample_date``, ``features`` (an array of one length) and the label; rows without a label are left
    out. All penalties of a window are solved from one matrix. Windows without a row, and an empty schedule, give none.
    """
    spark = samples.sparkSession
    windows = train_borders(plan)
    if windows.empty:
        return spark.createDataFrame([], MODEL)
    cuts = sorted({int(x) for x in windows["first"]} | {int(x) + 1 for x in windows["last"]})
    weeks = plan.where("role = 'train'").select("week_ord", F.col("date").alias("sample_date")).distinct()
    rows = samples.where(F.col(label).isNotNull()).join(F.broadcast(weeks), "sample_date")  # one row per week
    if rows.isEmpty():
        return spark.createDataFrame([], MODEL)
    shift = rows.agg(Summarizer.mean(array_to_vector("features")).alias("m")).first()["m"].toArray()
    sums = block_moments(rows, cuts, shift, label)
    spans = [(int(w.window_id), int(np.searchsorted(cuts, w.first)), int(np.searchsorted(cuts, w.last + 1))) for w in windows.itertuples()]

    def per_window(strip: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(strip["block"].tolist(), strip["sums"]))
        out = []
        for window, begin, end in spans:
            parts = [own[b] for b in range(begin, end) if b in own]
            if parts:
                out.append((window, int(strip["strip"].iloc[0]), np.sum(parts, axis=0)))
        return pd.DataFrame(out, columns=["window_id", "strip", "sums"])

    def fitted(strips: pd.DataFrame) -> pd.DataFrame:
        width = len(shift) + 2
        matrix = np.concatenate(strips.sort_values("strip")["sums"].to_list()).reshape(width, width)
        solved = [(strips["window_id"].iloc[0], a, *solve(matrix, shift, a)) for a in alphas]
        return pd.DataFrame(solved, columns=["window_id", "alpha", "n", "intercept", "coefficients"])

    whole = sums.groupBy("strip").applyInPandas(per_window, "window_id long, strip long, sums array<double>")
    return whole.groupBy("window_id").applyInPandas(fitted, MODEL)


def score(samples: DataFrame, plan: DataFrame, models: DataFrame, roles: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``window_id, alpha, role, date, entity, score`` (and ``keep``): samples scored by the models of the windows they serve.

    Weeks and models number as the calendar's windows, so both are broadcast.
    """
    weeks = plan.where(F.col("role").isin(*roles)).select("window_id", "role", F.col("date").alias("sample_date"))
    routed = samples.join(F.broadcast(weeks), "sample_date").join(F.broadcast(models.drop("n")), "window_id")
    products = F.zip_with("features", "coefficients", lambda x, w: x * w)
    total = F.aggregate(products, F.lit(0.0), lambda a, p: a + p)
    return routed.select("window_id", "alpha", "role", F.col("sample_date").alias("date"), "entity", (total + F.col("intercept")).alias("score"), *keep)
