"""Outlier clipping and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.fixed_values import SCALE_EPS
from tapeloom.functions.scalars import clip, finite
from tapeloom.operators.crosssection import medians, with_quantiles


def mad_clip(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("sample_date", "t_pos"),
    k: float = 3.0,
    zero_missing: bool = True,
) -> DataFrame:
    """Clamp each column to median +/- ``k`` median absolute deviations of its cross-section.

    Missing and non-finite values count as 0 unless ``zero_missing`` is off.
    """
    by = list(by)
    ready = df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) if zero_missing else finite(c) for c in columns})
    middle = medians(ready, by, columns).withColumnsRenamed({c: f"{c}_mid" for c in columns})
    centred = ready.select(*by, *columns).join(middle, by)
    spread = medians(centred.withColumns({c: F.abs(F.col(c) - F.col(f"{c}_mid")) for c in columns}), by, columns)
    bounds = middle.join(spread.withColumnsRenamed({c: f"{c}_mad" for c in columns}), by)
    clipped = {}
    for c in columns:
        reach = k * (F.col(f"{c}_mad") + SCALE_EPS)
        clipped[c] = clip(c, F.col(f"{c}_mid") - reach, F.col(f"{c}_mid") + reach)
    return ready.join(bounds, by).withColumns(clipped).select(*df.columns)


def winsorize(df: DataFrame, value: str, pct: float, by: Sequence[str], out: str | None = None) -> DataFrame:
    """Clamp to the ``pct`` and ``1 - pct`` quantiles of the group."""
    out = out or value
    if pct <= 0:
        return df.withColumn(out, F.col(value))
    edges = with_quantiles(df, by, value, {"_lo": pct, "_hi": 1.0 - pct})
    return df.join(edges, list(by), "left").withColumn(out, clip(value, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def fit_scaler(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), zero_missing: bool = True) -> DataFrame:
    """Mean and population deviation (plus the guard) of each column, one row per group."""
    moments = []
    for c in columns:
        v = F.coalesce(finite(c), F.lit(0.0)) if zero_missing else finite(c)
        moments += [F.avg(v).alias(f"{c}_mean"), (F.stddev_pop(v) + SCALE_EPS).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*moments)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = (), zero_missing: bool = False) -> DataFrame:
    """Standardise with stored parameters, one row per group; the single row of an ungrouped scaler is broadcast."""
    joined = df.join(scaler, list(by)) if by else df.join(F.broadcast(scaler), F.lit(True))
    scaled = {}
    for c in columns:
        z = (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        scaled[c] = F.coalesce(finite(z), F.lit(0.0)) if zero_missing else z
    return joined.withColumns(scaled).select(*df.columns)


def scale_only(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Divide by the population deviation without centring; a constant column is left as it is."""
    spread = df.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"{c}_std") for c in columns])
    joined = df.join(spread, list(by)) if by else df.join(F.broadcast(spread), F.lit(True))
    return joined.withColumns(
        {c: F.when(F.col(f"{c}_std") > 0, F.col(c) / F.col(f"{c}_std")).otherwise(F.col(c)) for c in columns}
    ).select(*df.columns)
