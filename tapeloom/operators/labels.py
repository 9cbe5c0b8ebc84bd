"""Forward returns from week end to week end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import Costs
from tapeloom.functions.scalars import finite
from tapeloom.operators.calendar import align_dates, days, missing_samples
from tapeloom.sources.upsert import upsert


def label_weeks(market_days: DataFrame, weeks: DataFrame) -> DataFrame:
    """Per week end: the market day that closes it, the next week's close day and first day.

    Weeks whose first day would fall after their last are dropped.
    """
    market = days(market_days)
    pairs = weeks.where("next_week_end IS NOT NULL").select(F.col("date").alias("sample_date"), "next_week_end")
    closes = align_dates(
        pairs.select(F.col("sample_date").alias("date")).union(pairs.select("next_week_end")), market, "market_day"
    )
    return (
        pairs.join(closes.toDF("sample_date", "close_day"), "sample_date")
        .join(closes.toDF("next_week_end", "end_day"), "next_week_end")
        .join(market.select(F.col("date").alias("close_day"), F.col("next_date").alias("start_day")), "close_day")
        .where("start_day <= end_day")
        .select("sample_date", "close_day", "start_day", "end_day")
    )


def weekly_labels(bars: DataFrame, weeks: DataFrame, costs: Costs | None = None, market_days: DataFrame | None = None) -> DataFrame:
    """Open-to-close return of the week after each sample date, net of ``costs`` if given.

    Market days are those on which any entity trades. The two price lookups
    are equality joins and the plan (a row per week) is broadcast, so only the
    needed days of the panel are shuffled.
    """
    plan = label_weeks(bars.select("date") if market_days is None else market_days, weeks)
    buy, sell = (costs.buy, costs.sell) if costs else (0.0, 0.0)
    opens = bars.select("entity", F.col("date").alias("start_day"), F.col("open").alias("_o"))
    closes = bars.select("entity", F.col("date").alias("end_day"), F.col("close").alias("_c"))
    joined = opens.join(F.broadcast(plan), "start_day").join(closes, ["end_day", "entity"])
    if costs:
        ret = F.try_divide(F.col("_c") * (1.0 - sell), F.col("_o") * (1.0 + buy)) - 1
    else:
        ret = F.try_divide(F.col("_c"), F.col("_o")) - 1
    return joined.select("sample_date", "entity", finite(ret).alias("next_week_return")).where(
        "next_week_return IS NOT NULL"
    )


def update_labels(stored: DataFrame | None, bars: DataFrame, weeks: DataFrame) -> DataFrame:
    """Labels for the missing weeks and the last stored one; new values replace old ones."""
    if stored is None:
        return weekly_labels(bars, weeks)
    wanted = weeks.where("next_week_end IS NOT NULL")
    todo = missing_samples(wanted, stored.select(F.col("sample_date").alias("date")).distinct())
    fresh = weekly_labels(bars, weeks.join(todo, "date", "left_semi"), market_days=bars.select("date"))
    return upsert(stored, fresh, ("sample_date", "entity"))


def asset_week_returns(bars: DataFrame, weeks: DataFrame, mode: str = "o2c") -> DataFrame:
    """Weekly return of each series, open-to-close or close-to-close; non-positive bases dropped.

    Unlike :func:`weekly_labels` each series uses its own trading days.
    """
    own = bars.select("entity", "date", "open", "close")
    pairs = weeks.where("next_week_end IS NOT NULL").select(F.col("date").alias("sample_date"), "next_week_end")
    per = own_alignment(own, weeks)
    begin = per.toDF("entity", "sample_date", "close_day", "close_at", "start_day", "open_at")
    finish = per.select("entity", F.col("date").alias("next_week_end"), F.col("day").alias("end_day"), F.col("close").alias("end_close"))
    joined = begin.join(F.broadcast(pairs), "sample_date").join(finish, ["entity", "next_week_end"])
    if mode == "o2c":
        joined = joined.where("start_day <= end_day")
        base = F.col("open_at")
    else:
        base = F.col("close_at")
    return joined.where(base > 0).select(
        "entity", "sample_date", finite(F.try_divide(F.col("end_close"), base) - 1).alias("ret")
    ).where("ret IS NOT NULL")


def own_alignment(own: DataFrame, weeks: DataFrame) -> DataFrame:
    """Per series and week end: its last own day at or before it, that close, and the next own day and open."""
    w = Window.partitionBy("entity").orderBy("date")
    ends = weeks.select("date")
    rows = own.select(
        "entity",
        F.col("date").alias("day"),
        "close",
        F.lead("date").over(w).alias("next_day"),
        F.lead("open").over(w).alias("next_open"),
        F.col("date"),
    )
    ordinal = weeks.select("date", "week_ord")
    all_days = own.select("date").distinct()
    from_week = next_week_ord(all_days, ordinal)
    last = weeks.agg(F.max("week_ord").alias("_last"))
    spans = (
        rows.join(F.broadcast(from_week.toDF("date", "_from")), "date")
        .join(F.broadcast(from_week.toDF("next_day", "_until")), "next_day", "left")
        .join(F.broadcast(last), F.lit(True))
        .withColumn("_to", F.coalesce(F.col("_until") - 1, F.col("_last")))
        .where("_from <= _to")
    )
    expanded = spans.select(
        "entity", "day", "close", "next_day", "next_open", F.explode(F.sequence("_from", "_to")).alias("week_ord")
    )
    return expanded.join(F.broadcast(ordinal), "week_ord").select("entity", "date", "day", "close", "next_day", "next_open")


def next_week_ord(dates: DataFrame, weeks: DataFrame) -> DataFrame:
    """Ordinal of the first week end at or after each date (one past the last if there is none)."""
    ahead = Window.orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = dates.join(weeks.select("date", "week_ord"), "date", "full")
    total = weeks.agg((F.max("week_ord") + 1).alias("_past"))
    found = both.withColumn("_at", F.first("week_ord", ignorenulls=True).over(ahead))
    return found.join(F.broadcast(total), F.lit(True)).join(dates, "date", "left_semi").select(
        "date", F.coalesce("_at", "_past").alias("at")
    )
