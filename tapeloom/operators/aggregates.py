"""Sector bars, market context and daily portfolio features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.fixed_values import CONTEXT_SPANS
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import finite, over
from tapeloom.operators.calendar import align_dates, missing_samples
from tapeloom.operators.crosssection import mean_within, with_quantiles
from tapeloom.sources.upsert import upsert


def sector_bars(bars: DataFrame, sectors: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Turnover-weighted daily bar and breadth of each target sector, in one pass."""
    members = sectors.select("entity", "sector").where(F.col("sector").isin(*targets))
    values = ["open", "close", "volume", "total_turnover", "num_trades"]
    rows = bars.select("entity", "date", *[finite(c).alias(c) for c in values]).where(
        "close IS NOT NULL AND total_turnover IS NOT NULL"
    ).join(members, "entity")
    move = F.try_divide(F.col("close"), F.col("open")) - 1
    turnover = F.sum("total_turnover")
    weighted = F.sum(F.col("close") * F.col("total_turnover")) / turnover
    direction = F.when(move > 0, 1).when(move < 0, -1).when(F.col("open").isNotNull(), 0)
    return rows.groupBy("date", "sector").agg(
        F.when(turnover > 0, weighted).otherwise(F.avg("close")).alias("close"),
        turnover.alias("total_turnover"),
        F.sum("volume").alias("volume"),
        F.sum("num_trades").alias("num_trades"),
        F.count(F.lit(1)).alias("constituents_count"),
        F.avg(direction).alias("breadth"),
    )


def series_features(series: DataFrame) -> DataFrame:
    """Seventeen return and turnover features per ``(entity, date)`` of index or sector series."""
    df = series.select("entity", "date", "close", "total_turnover").withColumn("_cf", R.forward_fill("close"))
    df = df.withColumn("ret_1d", R.pct_change("_cf"))
    out = {"ret_1d": F.col("ret_1d")}
    for n in CONTEXT_SPANS:
        out[f"ret_mean_{n}"] = R.rolling_mean("ret_1d", n)
        out[f"ret_std_{n}"] = R.rolling_std("ret_1d", n)
        out[f"to_mean_ratio_{n}"] = over(R.rolling_mean("total_turnover", n), "total_turnover")
        out[f"to_std_ratio_{n}"] = over(R.rolling_std("total_turnover", n), F.abs("total_turnover"))
    return df.select("entity", "date", *[c.alias(n) for n, c in out.items()])


def style_breadth(sector_series: DataFrame, n_sectors: int) -> DataFrame:
    """Rising minus falling sectors over all sectors, per date; a missing return counts as neither."""
    df = sector_series.withColumn("_cf", R.forward_fill("close")).withColumn("_r", R.pct_change("_cf"))
    up, down = F.count_if(F.col("_r") > 0), F.count_if(F.col("_r") < 0)
    return df.groupBy("date").agg(((up - down) / n_sectors).alias("bread_style"))


def context_features(index_bars: DataFrame, sector_series: DataFrame, weeks: DataFrame,
                     indices: Sequence[str], sectors: Sequence[str]) -> DataFrame:
    """One row per week end: every series' features as of its last market day, plus style breadth."""
    names = ["ret_1d"] + [f"{m}_{n}" for n in CONTEXT_SPANS for m in ("ret_mean", "ret_std", "to_mean_ratio", "to_std_ratio")]

    def at_week_ends(series: DataFrame, members: Sequence[str]) -> DataFrame:
        days = align_dates(weeks, series, "day")
        features = series_features(series).withColumnRenamed("date", "day")
        wide = features.join(F.broadcast(days), "day").groupBy("date").pivot("entity", list(members)).agg(
            *[F.first(n).alias(n) for n in names]
        )
        return wide

    breadth_days = align_dates(weeks, sector_series, "day")
    breadth = breadth_days.join(style_breadth(sector_series, len(sectors)).withColumnRenamed("date", "day"), "day")
    out = (
        at_week_ends(index_bars, indices)
        .join(at_week_ends(sector_series, sectors), "date")
        .join(breadth.select("date", "bread_style"), "date")
    )
    return out.select("date", *[finite(c).alias(c) for c in out.columns if c != "date"])


def update_context(stored: DataFrame | None, index_bars: DataFrame, sector_series: DataFrame, weeks: DataFrame,
                   indices: Sequence[str], sectors: Sequence[str]) -> DataFrame:
    """Context of the missing weeks and the last stored one; new rows replace old ones."""
    if stored is None:
        return context_features(index_bars, sector_series, weeks, indices, sectors)
    todo = missing_samples(weeks, stored)
    fresh = context_features(index_bars, sector_series, todo, indices, sectors)
    return upsert(stored, fresh, ("date",))


def cross_section_features(returns: DataFrame) -> DataFrame:
    """Daily shape of the per-name returns: counts, weighted shares, moments and quantiles."""
    rows = returns.select(
        "date", F.coalesce(F.col("weight"), F.lit(0.0)).alias("w"), F.coalesce(F.col("ret"), F.lit(0.0)).alias("r")
    )
    up, n, wsum = F.col("r") > 0, F.count(F.lit(1)), F.sum("w")
    w_up = F.sum(F.when(up, F.col("w")).otherwise(0.0))
    moments = rows.groupBy("date").agg(
        n.alias("cs_n"),
        F.count_if(up).alias("cs_n_up"),
        F.count_if(~up).alias("cs_n_dn"),
        (F.count_if(up) / n).alias("cs_ratio_up"),
        F.when(wsum > 0, w_up / wsum).otherwise(0.0).alias("cs_ratio_w_up"),
        F.avg("r").alias("cs_mean_ret"),
        F.sum(F.col("w") * F.col("r")).alias("cs_wmean_ret"),
        F.stddev_pop("r").alias("cs_std_ret"),
        (F.count_if(F.col("r") > 0.02) / n).alias("cs_frac_big_up"),
        (F.count_if(F.col("r") < -0.02) / n).alias("cs_frac_big_dn"),
    )
    shape = with_quantiles(rows, ["date"], "r", {"cs_p10_ret": 0.1, "cs_p50_ret": 0.5, "cs_p90_ret": 0.9})
    return moments.join(shape, "date").withColumn("cs_median_ret", F.col("cs_p50_ret"))


def position_features(positions: DataFrame) -> DataFrame:
    stats = positions.groupBy("date").agg(
        F.count_distinct("entity").alias("pos_n_stock"),
        F.avg("score").alias("pos_mean_score"),
        F.stddev_pop("score").alias("pos_std_score"),
    )
    return stats.join(with_quantiles(positions, ["date"], "score", {"pos_median_score": 0.5}), "date", "left")


def trade_features(trades: DataFrame) -> DataFrame:
    """Buy/sell ratio and net direction per trade; trailing stops count as direction 0."""
    action = F.col("action")
    direction = F.when(action == "BUY", 1).when(action.isin("SELL", "TP", "SL"), -1).otherwise(0)
    buys, sells = F.count_if(action == "BUY"), F.count_if(action == "SELL")
    return trades.groupBy("date").agg(
        (buys / F.greatest(sells, F.lit(1))).alias("trd_buy_sell_ratio"),
        (F.sum(direction) / F.count(F.lit(1))).alias("trd_net_dir_norm"),
    )


def daily_features(nav: DataFrame, returns: DataFrame, positions: DataFrame, trades: DataFrame) -> DataFrame:
    """Daily return with cross-section, position and trade features; gaps become 0."""
    joined = nav.select("date", "ret_total")
    for part in (cross_section_features(returns), position_features(positions), trade_features(trades)):
        joined = joined.join(part, "date", "left")
    return joined.fillna(0)


def peer_average(df: DataFrame, value: str, by: Sequence[str] = ("date", "industry"), out: str = "peer_mean") -> DataFrame:
    """Group mean attached to each member."""
    return mean_within(df, list(by), value, out)
