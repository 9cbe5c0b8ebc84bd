"""From scores to daily target positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import Selection
from tapeloom.operators.calendar import align_dates, by_date, days
from tapeloom.operators.cleaning import winsorize
from tapeloom.operators.crosssection import attach, best_n, mean_within, with_quantiles
from tapeloom.sources.upsert import with_dimension


def load_scores(scores: DataFrame, start=None, end=None) -> DataFrame:
    """Scores inside a date range, without missing keys or values."""
    out = scores.where("date IS NOT NULL AND entity IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.select("date", "entity", "score")


def industry_neutral(scores: DataFrame, industry_ids: DataFrame, clip_pct: float = 0.0) -> DataFrame:
    """``score_neutral``: score less its date-and-industry mean, after clipping.

    A regression on industry dummies leaves exactly this residual, so no solver
    is involved.
    """
    clipped = winsorize(scores, "score", clip_pct, ["date"], "_s")
    grouped = mean_within(with_dimension(clipped, industry_ids), ["date", "industry_id"], "_s", "_peer")
    return grouped.withColumn("score_neutral", F.col("_s") - F.col("_peer")).drop("_s", "_peer", "industry_id")


def size_bins(caps: DataFrame, n_bins: int, clip_pct: float = 0.0) -> DataFrame:
    """Quantile bin of log market cap per date: right-closed, duplicate edges dropped.

    Dates with fewer valid caps than ``max(4, n_bins)`` get no bins.
    """
    logs = caps.where("market_cap > 0").select("date", "entity", F.log("market_cap").alias("_x"))
    logs = winsorize(logs, "_x", clip_pct, ["date"])
    edges = with_quantiles(logs, ["date"], "_x", {f"_e{i}": i / n_bins for i in range(n_bins + 1)})
    valid = logs.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(4, n_bins))
    table = edges.join(valid, "date").select(
        "date", F.array_distinct(F.array(*[f"_e{i}" for i in range(n_bins + 1)])).alias("_edges")
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col("_x")))
    return logs.join(table, "date").select("date", "entity", (F.greatest(below, F.lit(1)) - 1).alias("size_bin"))


def size_neutral(scores: DataFrame, caps: DataFrame, base: str, n_bins: int = 5, clip_pct: float = 0.0) -> DataFrame:
    """``score_neutral_mkt``: base score less its date-and-size-bin mean.

    Names without a bin (no cap, or too few caps that day) keep the base score.
    """
    present = scores.select("date", "entity").join(caps, ["date", "entity"])
    binned = scores.join(size_bins(present, n_bins, clip_pct), ["date", "entity"], "left")
    means = binned.where("size_bin IS NOT NULL").groupBy("date", "size_bin").agg(F.avg(base).alias("_mean"))
    out = binned.join(means, ["date", "size_bin"], "left")
    return out.withColumn("score_neutral_mkt", F.coalesce(F.col(base) - F.col("_mean"), F.col(base))).drop("_mean", "size_bin")


def score_column(industry: bool, size: bool) -> str:
    """The column that selection sorts by, given the neutralisation switches."""
    return "score_neutral_mkt" if size else "score_neutral" if industry else "score"


def select_names(scores: DataFrame, cfg: Selection, by: str = "score") -> DataFrame:
    """Top names per date with weights.

    The number of names is a share of the date's candidates inside the
    configured limits. Only ``max(max_n, min_n)`` rows per date leave each task.
    """
    limit = max(cfg.max_n, cfg.min_n)
    counts = scores.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    top = best_n(scores, ["date"], [F.col(by).desc_nulls_last(), F.col("entity")], limit, "_rn")
    target = F.least(F.floor(F.col("_n") * cfg.top_pct), F.lit(cfg.max_n))
    target = F.when((target <= 0) & (F.col("_n") >= cfg.min_n), F.least(F.lit(cfg.min_n), F.col("_n"))).otherwise(target)
    picked = top.join(counts, "date").where(F.col("_rn") <= target)
    if cfg.positive_only:
        picked = picked.where(F.col(by) > 0)
    sized = attach(picked, ["date"], {"_k": F.count(F.lit(1)), "_total": F.sum(F.greatest(by, F.lit(0.0)))})
    sized = sized.where(F.col("_k") >= cfg.min_n)
    equal = F.lit(1.0) / F.col("_k")
    if cfg.weight_mode == "equal":
        weight = equal
    else:
        weight = F.when(F.col("_total") > 0, F.greatest(by, F.lit(0.0)) / F.col("_total")).otherwise(equal)
    return sized.withColumn("weight", weight).drop("_rn", "_n", "_k", "_total")


def rebalance_plan(scored_weeks: DataFrame, selected: DataFrame, every: int = 1) -> DataFrame:
    """Per scored week: the week its names were picked and its signal date.

    Names change on every ``every``-th week; an empty selection keeps the last
    portfolio. The signal date is the latest rebalancing week that holds a
    portfolio, its own or a kept one.
    """
    w = by_date()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = selected.select("date").distinct().withColumn("_has", F.lit(True))
    weeks = scored_weeks.select("date").distinct().join(filled, "date", "left").select(
        "date", ((F.row_number().over(w) - 1) % every == 0).alias("_turn"), F.coalesce("_has", F.lit(False)).alias("_has")
    )
    picked = F.last(F.when(F.col("_turn") & F.col("_has"), F.col("date")), ignorenulls=True).over(so_far)
    planned = weeks.withColumn("pick_date", picked)
    signal = F.last(F.when(F.col("_turn") & F.col("pick_date").isNotNull(), F.col("date")), ignorenulls=True).over(so_far)
    return planned.select("date", "pick_date", F.coalesce(signal, F.col("date")).alias("signal_date")).where("pick_date IS NOT NULL")


def daily_positions(selected: DataFrame, plan: DataFrame, scored_weeks: DataFrame, calendar: DataFrame, end=None) -> DataFrame:
    """Copy each week's portfolio to its trading days and move it to the next trading day.

    Every calendar day is mapped to its scored week first, so the copy is an
    equality join. Days whose next trading day is unknown are dropped.
    """
    market = days(calendar)
    if end is not None:
        market = market.where(F.col("date") <= F.lit(end).cast("date"))
    of_week = align_dates(market, scored_weeks, "week").join(market.select("date", "next_date"), "date")
    schedule = of_week.where("next_date IS NOT NULL").join(plan.withColumnRenamed("date", "week"), "week")
    names = selected.withColumnRenamed("date", "pick_date")
    spread = F.broadcast(schedule.select("pick_date", "signal_date", F.col("next_date").alias("date")))
    return names.join(spread, "pick_date").drop("pick_date")
