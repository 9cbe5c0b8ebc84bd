"""Rank correlation, turnover, drawdown and performance of return series.

Series operators take a ``series_id`` key, so any number of strategies or
parameter sets run as one job; a series has one row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import correlation, finite
from tapeloom.operators.calendar import align_series
from tapeloom.operators.crosssection import attach, positions_of, ranks

SERIES = ("series_id",)


def _path(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def _so_far(keys: Sequence[str]):
    return _path(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rank_ic(scores: DataFrame, returns: DataFrame, min_names: int = 5) -> DataFrame:
    """Spearman correlation per date with averaged ties, for dates with enough names.

    ``scores(date, entity, score)`` against ``returns(sample_date, entity, next_week_return)``.
    """
    pairs = scores.select("date", "entity", "score").join(
        returns.select(F.col("sample_date").alias("date"), "entity", F.col("next_week_return").alias("ret")),
        ["date", "entity"],
    ).where("score IS NOT NULL AND ret IS NOT NULL")
    ranked = ranks(pairs, ["date"], "entity", {"score": "_rs", "ret": "_rr"})
    return (
        ranked.groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            correlation("_rs", "_rr").alias("rank_ic"),
        )
        .where(F.col("n") >= min_names)
    )


def rank_ic_ordinal(df: DataFrame, pred: str = "score", target: str = "ret", by: Sequence[str] = ("date",)) -> DataFrame:
    """Rank correlation of positions (no shared ranks); 0 for fewer than two names."""
    ranked = positions_of(df, by, "entity", {pred: "_p", target: "_t"})
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(correlation("_p", "_t"), F.lit(0.0)).alias("rank_ic"),
    )


def pearson_ic(df: DataFrame, pred: str = "score", target: str = "ret", by: Sequence[str] = ("date",)) -> DataFrame:
    moves = (F.var_pop(pred) > 1e-12) & (F.var_pop(target) > 1e-12)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(moves, correlation(pred, target)).alias("ic"))


def _stats(value: str, names: tuple[str, str, str, str]) -> list[Column]:
    n, mean, std, ratio = names
    dev = F.stddev_samp(value)
    return [
        F.count(value).alias(n),
        F.avg(value).alias(mean),
        dev.alias(std),
        F.when(dev > 0, F.avg(value) / dev).alias(ratio),
    ]


def ic_summary(ic: DataFrame, value: str = "rank_ic", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, information ratio and t value of an IC series, or of each series that ``keys`` tell apart."""
    dev = F.stddev_samp(value)
    t = F.when(dev > 0, F.avg(value) / (dev / F.sqrt(F.count(value).cast("double"))))
    return ic.groupBy(*keys).agg(*_stats(value, ("n_weeks", "ic_mean", "ic_std", "icir")), t.alias("t_stat"))


def yearly_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation and ratio per series and year, with the overall row (``year`` NULL) in the same pass."""
    keyed = df.withColumn("year", F.explode(F.array(F.year("date"), F.lit(None).cast("int"))))
    return keyed.groupBy(*keys, "year").agg(*_stats(value, ("n", "mean", "std", "ir")))


def normalised_weights(positions: DataFrame) -> DataFrame:
    """One weight per date and entity, duplicates summed, scaled to sum 1 where the sum is positive."""
    summed = positions.groupBy("date", "entity").agg(F.sum("weight").alias("weight"))
    both = attach(summed, ["date"], {"_sum": F.sum("weight")})
    scaled = F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(F.col("weight"))
    return both.select("date", "entity", scaled.alias("weight"))


def turnover(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half the absolute weight change from one position date to the next, clipped to [0, 1], per series.

    Each weight is counted once at its own date and once, negated, at the next
    one; the first date has no predecessor and is left out.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    stamps = weights.select(*keys, "date").distinct().select(
        *keys, "date", F.lead("date").over(w).alias("next_date"), F.lag("date").over(w).alias("prev_date")
    )
    moves = weights.join(stamps, [*keys, "date"]).select(
        *keys, "entity",
        F.explode(
            F.array(
                F.struct(F.col("date").alias("at"), F.col("weight").alias("dw"), F.col("prev_date").isNull().alias("first")),
                F.struct(F.col("next_date").alias("at"), (-F.col("weight")).alias("dw"), F.lit(False).alias("first")),
            )
        ).alias("m"),
    ).select(*keys, "entity", "m.at", "m.dw", "m.first").where("at IS NOT NULL")
    change = moves.groupBy(*keys, "at", "entity").agg(F.sum("dw").alias("dw"), F.max("first").alias("first"))
    daily = change.groupBy(*keys, "at").agg(F.sum(F.abs("dw")).alias("moved"), F.max("first").alias("first"))
    return daily.where(~F.col("first")).select(
        *keys, F.col("at").alias("date"), F.least(F.greatest(0.5 * F.col("moved"), F.lit(0.0)), F.lit(1.0)).alias("turnover")
    )


def read_returns(nav: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Returns of a NAV table: ``ret_total`` if a series has any, else changes of ``nav``."""
    clean = nav.withColumns({"ret_total": finite("ret_total"), "nav": finite("nav")})
    known = attach(clean, keys, {"_has": F.count("ret_total") > 0})
    w = _path(keys).rowsBetween(Window.unboundedPreceding, -1)
    change = F.try_divide(F.col("nav"), F.last("nav", ignorenulls=True).over(w)) - 1
    ret = F.when(F.col("_has"), F.col("ret_total")).otherwise(F.when(F.col("nav").isNotNull(), change))
    return known.withColumn("ret", ret).select(*keys, "date", "ret").where("ret IS NOT NULL")


def standard_nav(returns: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Compounded NAV whose first value reads 1; later values still contain the first return."""
    nav = F.product(1 + F.col("ret")).over(_so_far(keys))
    return returns.withColumn("nav", F.when(F.row_number().over(_path(keys)) == 1, F.lit(1.0)).otherwise(nav))


def drawdown_path(nav: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    peak = F.max("nav").over(_so_far(keys))
    return nav.where(finite("nav").isNotNull()).withColumn("peak", peak).withColumn(
        "drawdown", 1 - F.try_divide(F.col("nav"), F.col("peak"))
    )


def max_drawdown(nav: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Deepest fall: size, first date of the trough, first date at the peak before it, days between them."""
    path = drawdown_path(nav, keys)
    deepest = path.groupBy(*keys).agg(
        F.max(F.struct("drawdown", (-F.unix_date("date")).alias("early"), "date", "peak")).alias("t")
    ).select(*keys, F.col("t.drawdown").alias("max_drawdown"), F.col("t.date").alias("trough"), F.col("t.peak").alias("_at"))
    at_peak = path.join(deepest, list(keys)).where(
        (F.col("date") <= F.col("trough")) & (F.abs(F.col("nav") - F.col("_at")) <= 1e-12)
    )
    first = at_peak.groupBy(*keys).agg(F.min("date").alias("peak_date"))
    return deepest.join(first, list(keys)).select(
        *keys,
        "max_drawdown",
        F.col("peak_date").alias("start_date"),
        F.col("trough").alias("end_date"),
        F.datediff("trough", "peak_date").cast("long").alias("recovery_days"),
    )


def performance(returns: DataFrame, keys: Sequence[str] = SERIES, freq: int = 252, rf: float = 0.0) -> DataFrame:
    """Total and geometric annual return, volatility, Sharpe, drawdown, Calmar and periods per group.

    Drawdown starts at the first compounded value, not at 1.
    """
    keys = list(keys)
    clean = returns.where(finite("ret").isNotNull())
    nav = clean.withColumn("nav", F.product(1 + F.col("ret")).over(_so_far(keys)))
    fall = drawdown_path(nav, keys)
    dev = F.stddev_samp("ret")
    root = float(freq) ** 0.5
    grouped = fall.groupBy(*keys).agg(
        (F.max_by("nav", "date") - 1).alias("total_return"),
        F.avg("ret").alias("_mean"),
        dev.alias("_dev"),
        F.max("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    annual = F.pow(1 + F.col("total_return"), F.lit(float(freq)) / F.col("n_periods")) - 1
    return grouped.withColumn("annual_return", annual).select(
        *keys,
        "total_return",
        "annual_return",
        F.coalesce(F.col("_dev") * root, F.lit(0.0)).alias("annual_vol"),
        F.when(F.col("_dev") > 0, (F.col("_mean") - rf / freq) / F.col("_dev") * root).alias("sharpe"),
        "max_drawdown",
        F.when(F.col("max_drawdown") > 1e-12, F.col("annual_return") / F.col("max_drawdown")).alias("calmar"),
        "n_periods",
    )


def full_metrics(returns: DataFrame, keys: Sequence[str] = SERIES, freq: int = 252) -> DataFrame:
    """Performance overall (``year`` NULL) and per calendar year.

    Each return is emitted for its year and for the whole, so one grouped job serves both.
    """
    scopes = F.explode(F.array(F.lit(None).cast("int"), F.year("date"))).alias("year")
    both = returns.select(*keys, "date", "ret", scopes)
    return performance(both, [*keys, "year"], freq)


def excess(main: DataFrame, bench: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Return differences on common dates and their compounded NAV."""
    joined = main.select(*keys, "date", F.col("ret").alias("_m")).join(bench.select("date", F.col("ret").alias("_b")), "date")
    diff = joined.select(*keys, "date", (F.col("_m") - F.col("_b")).alias("ret"))
    return diff.withColumn("excess_nav", F.product(1 + F.col("ret")).over(_so_far(keys)))


def simple_performance(returns: DataFrame, keys: Sequence[str] = SERIES, freq: int = 252, rf: float = 0.0) -> DataFrame:
    """Annual return from the mean period return, volatility and their ratio."""
    grouped = returns.groupBy(*keys).agg(
        (F.pow(1 + F.avg("ret"), F.lit(freq)) - 1).alias("annual_return"),
        (F.stddev_samp("ret") * float(freq) ** 0.5).alias("annual_vol"),
    )
    return grouped.withColumn(
        "sharpe", F.when(F.col("annual_vol") > 0, (F.col("annual_return") - rf) / F.col("annual_vol"))
    )


def performance_report(returns: DataFrame, main: str, bench: str, freq: int = 252) -> DataFrame:
    """Metrics of every series and of main-minus-benchmark, all on their common dates."""
    common = align_series(returns, "intersection", value="ret")
    diff = excess(
        common.where(F.col("series_id") == main), common.where(F.col("series_id") == bench)
    ).select(F.concat("series_id", F.lit(f" - {bench}")).alias("series_id"), "date", "ret")
    return full_metrics(common.unionByName(diff), SERIES, freq)
