"""Trading calendar, week ends, date alignment and walk-forward schedules.

Everything here works on distinct dates. A calendar of sixty years has about
fifteen thousand rows, so ordering it in one task is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import WalkForward

def by_date():
    return Window.orderBy("date")


def days(df: DataFrame) -> DataFrame:
    """Distinct dates with their ordinal, previous and next date."""
    return df.select("date").distinct().select(
        "date",
        (F.row_number().over(by_date()) - 1).cast("long").alias("ord"),
        F.lag("date").over(by_date()).alias("prev_date"),
        F.lead("date").over(by_date()).alias("next_date"),
    )


def week_ends(calendar: DataFrame) -> DataFrame:
    """Last trading day of each Monday-Sunday week, with its ordinal and the next week end."""
    ends = calendar.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max("date").alias("date"))
    return ends.select(
        "date",
        (F.row_number().over(by_date()) - 1).cast("long").alias("week_ord"),
        F.lead("date").over(by_date()).alias("next_week_end"),
    )


def gap_week_ends(calendar: DataFrame, include_last: bool = False) -> DataFrame:
    """Days whose next trading day is more than one calendar day away."""
    gap = F.datediff("next_date", "date") > 1
    keep = gap | F.col("next_date").isNull() if include_last else gap
    return days(calendar).where(keep).select("date")


def next_trading_day(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """First calendar day strictly after each date; dates past the end get NULL."""
    known = calendar.select("date", F.col("date").alias("trading_day"))
    asked = dates.select("date").distinct()
    later = by_date().rowsBetween(1, Window.unboundedFollowing)
    both = asked.join(known, "date", "full")
    out = both.withColumn("next_trading_day", F.first("trading_day", ignorenulls=True).over(later))
    return out.join(asked, "date", "left_semi").select("date", "next_trading_day")


def align_dates(targets: DataFrame, available: DataFrame, out: str = "aligned", keep_missing: bool = False) -> DataFrame:
    """As-of join of dates: the last available date at or before each target."""
    asked = targets.select("date").distinct()
    known = available.select("date").distinct().withColumn("_known", F.col("date"))
    both = asked.join(known, "date", "full")
    so_far = by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(out, F.last("_known", ignorenulls=True).over(so_far)).drop("_known")
    found = found.join(asked, "date", "left_semi")
    return found if keep_missing else found.where(F.col(out).isNotNull())


def as_of_rows(asked: DataFrame, table: DataFrame, key: str = "date") -> DataFrame:
    """Each asked date with the latest ``table`` row at or before it, or the earliest row if none is.

    ``table`` holds one row per date (context, model registry).
    """
    aligned = align_dates(asked, table, "_hit", keep_missing=True)
    earliest = table.agg(F.min(key).alias("_first"))
    keyed = aligned.join(F.broadcast(earliest), F.lit(True)).select(
        F.col("date"), F.coalesce("_hit", "_first").alias("picked"), F.col("_hit").isNull().alias("fallback")
    )
    return keyed.join(table.withColumnRenamed(key, "picked"), "picked")


def chained_alignment(dates: DataFrame, week_table: DataFrame, stored: DataFrame) -> DataFrame:
    """Any date to its week end and on to the last stored sample date."""
    to_week = align_dates(dates, week_table, "week_end")
    to_store = align_dates(to_week.select(F.col("week_end").alias("date")), stored, "sample_date")
    return to_week.join(to_store.withColumnRenamed("date", "week_end"), "week_end").select(
        "date", "week_end", "sample_date"
    )


def missing_samples(wanted: DataFrame, written: DataFrame) -> DataFrame:
    """Week ends not yet written, plus the last written one, which is always redone."""
    absent = wanted.select("date").join(written.select("date"), "date", "left_anti")
    last = written.agg(F.max("date").alias("date")).where("date IS NOT NULL")
    return absent.union(last).distinct()


def history_start(targets: DataFrame, lookback: int = 120) -> DataFrame:
    """First day of history needed: twice the lookback in calendar days before the first target."""
    return targets.agg(F.date_sub(F.min("date"), 2 * lookback).alias("history_start"))


def history_slice(panel: DataFrame, targets: DataFrame, lookback: int = 120) -> DataFrame:
    start = history_start(targets, lookback)
    return panel.join(F.broadcast(start), F.col("date") >= F.col("history_start")).drop("history_start")


def schedule(weeks: DataFrame, wf: WalkForward = WalkForward()) -> DataFrame:
    """Walk-forward windows: one row per window and week with its role.

    Windows step over week ordinals; roles are train, val and predict. The
    expansion is a generated sequence joined on the ordinal, not a range join.
    """
    total = weeks.agg(F.count(F.lit(1)).alias("n"))
    first, span = wf.train_weeks, wf.val_weeks
    starts = total.where(F.col("n") > first + span).select(
        F.explode(F.sequence(F.lit(first), F.col("n") - span - 1, F.lit(wf.step_weeks))).alias("at")
    )
    offset = F.col("offset")
    role = F.when(offset < 0, "train").when(offset < span, "val").otherwise("predict")
    rows = starts.select(
        "at", F.explode(F.sequence(F.lit(-first), F.lit(span + wf.step_weeks - 1))).alias("offset")
    ).select(
        ((F.col("at") - first) / wf.step_weeks).cast("long").alias("window_id"),
        (F.col("at") + offset).cast("long").alias("week_ord"),
        role.alias("role"),
    )
    return rows.join(weeks.select("week_ord", "date"), "week_ord")


def window_table(plan: DataFrame) -> DataFrame:
    """One row per window: first and last date of each role, and the prediction date."""
    def edge(f, role):
        return f(F.when(F.col("role") == role, F.col("date")))

    return plan.groupBy("window_id").agg(
        edge(F.min, "train").alias("train_start"),
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "val").alias("val_start"),
        edge(F.max, "val").alias("val_end"),
        edge(F.min, "predict").alias("pred_date"),
        edge(F.max, "predict").alias("pred_end"),
    )


def merge_spans(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping ``[start, end]`` intervals (model windows: one row per model)."""
    w = Window.orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) > F.col("_reach"), 1).otherwise(0)).over(w)
    return (
        spans.withColumn("_reach", reach)
        .withColumn("_island", island)
        .groupBy("_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def window_spans(starts: DataFrame, weeks: DataFrame, bt_start: Column, bt_end: Column, step_weeks: int = 52) -> DataFrame:
    """Span of each model's validity clipped to the backtest range, overlaps merged.

    ``starts`` holds model dates; each is aligned to its week end and lasts
    ``step_weeks`` week ends or until the calendar stops.
    """
    aligned = align_dates(starts, weeks, "start").select("start").distinct()
    ordinals = weeks.select("date", "week_ord")
    last = weeks.agg(F.max("week_ord").alias("_last"))
    begun = aligned.join(ordinals.withColumnRenamed("date", "start"), "start").join(F.broadcast(last), F.lit(True))
    ended = begun.withColumn("week_ord", F.least(F.col("week_ord") + step_weeks - 1, F.col("_last")))
    spans = ended.join(ordinals.withColumnRenamed("date", "end"), "week_ord").select(
        F.greatest("start", bt_start).alias("start"), F.least("end", bt_end).alias("end")
    )
    return merge_spans(spans.where("start <= end"))


def align_series(df: DataFrame, how: str = "intersection", series: str = "series_id", value: str = "ret") -> DataFrame:
    """Put several return series on common dates.

    ``intersection`` keeps dates every series has; ``union`` keeps all dates
    and fills a missing return with 0.
    """
    names = df.select(series).distinct()
    if how == "intersection":
        n_series = names.agg(F.count(F.lit(1)).alias("_all"))
        full = df.groupBy("date").agg(F.count_distinct(series).alias("_n"))
        shared = full.join(F.broadcast(n_series), F.col("_n") == F.col("_all")).select("date")
        return df.join(shared, "date", "left_semi").select(series, "date", value)
    return on_all_dates(df, series).select(series, "date", F.coalesce(value, F.lit(0.0)).alias(value))


def on_all_dates(df: DataFrame, series: str) -> DataFrame:
    """Every series on every date any series has: dates sit in one array per series row."""
    stamps = df.select("date").distinct().agg(F.collect_list("date").alias("_dates"))
    grid = (
        df.select(series)
        .distinct()
        .join(F.broadcast(stamps), F.lit(True))
        .select(series, F.explode("_dates").alias("date"))
    )
    return grid.join(df, [series, "date"], "left")


def align_navs(df: DataFrame, series: str = "series_id") -> DataFrame:
    """Union alignment of NAV frames: NAV carried forward, return 0, leading gaps dropped."""
    w = Window.partitionBy(series).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = on_all_dates(df, series).select(
        series,
        "date",
        F.coalesce("ret_total", F.lit(0.0)).alias("ret_total"),
        F.last("nav", ignorenulls=True).over(w).alias("nav"),
    )
    return out.where("nav IS NOT NULL")
