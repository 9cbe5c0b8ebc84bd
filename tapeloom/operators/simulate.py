"""Portfolio returns without stops: a pure join-and-aggregate job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import Costs
from tapeloom.operators.calendar import days


def market_days(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Days with positions and prices, with their neighbours and ordinal."""
    return days(positions.select("date").join(bars.select("date").distinct(), "date", "left_semi"))


def transitions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Per entity and day: today's and yesterday's weight with the prices the day needs.

    Each weight is sent to its own day and to the next one, so the two meet in
    one aggregation; nothing is pivoted and no gap is filled. ``path`` is add,
    keep or reduce.
    """
    market = market_days(positions, bars)
    held = positions.where("weight <> 0").join(F.broadcast(market.select("date", "next_date")), "date")
    none = F.lit(None).cast("double")
    sent = F.array(
        F.struct(F.col("date").alias("at"), F.col("weight").alias("w"), none.alias("p")),
        F.struct(F.col("next_date").alias("at"), none.alias("w"), F.col("weight").alias("p")),
    )
    both = (
        held.select("entity", F.explode(sent).alias("s"))
        .select("entity", "s.*")
        .where("at IS NOT NULL")
        .groupBy("entity", "at")
        .agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("prev_weight"))
        .withColumnRenamed("at", "date")
    )
    dated = both.join(F.broadcast(market.select("date", "prev_date", "ord")), "date")
    today = bars.select("entity", "date", "open", "high", "low", "close")
    before = bars.select("entity", F.col("date").alias("prev_date"), F.col("close").alias("prev_close"))
    path = F.when(F.col("prev_weight") == 0, "add").when(F.col("weight") != 0, "keep").otherwise("reduce")
    return dated.join(today, ["entity", "date"], "left").join(before, ["entity", "prev_date"], "left").withColumn("path", path)


def stock_returns(moves: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Each name's return and contribution per day."""
    buy = F.try_divide(F.col("close"), F.col("open") * (1 + costs.buy)) - 1
    hold = F.try_divide(F.col("close"), F.col("prev_close")) - 1
    sell = F.try_divide(F.col("open") * (1 - costs.sell), F.col("prev_close")) - 1
    ret = F.when(F.col("path") == "add", buy).when(F.col("path") == "keep", hold).otherwise(sell)
    weight = F.when(F.col("path") == "reduce", F.col("prev_weight")).otherwise(F.col("weight"))
    return moves.select("date", "entity", "path", weight.alias("weight"), ret.alias("ret")).withColumn(
        "contribution", F.col("weight") * F.col("ret")
    )


def daily_nav(returns: DataFrame, keys: tuple[str, ...] = (), every: DataFrame | None = None) -> DataFrame:
    """Daily portfolio return, number held and compounded NAV per series.

    ``every`` lists the keys and dates that get a row, with return 0 where nothing is held.
    """
    held = F.count_if(F.col("path").isin("add", "keep"))
    daily = returns.groupBy(*keys, "date").agg(
        F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("ret_long"), held.alias("n_long")
    )
    if every is not None:
        daily = every.join(daily, [*keys, "date"], "left").fillna({"ret_long": 0.0, "n_long": 0})
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        *keys,
        "date",
        "ret_long",
        F.lit(0.0).alias("ret_short"),
        F.col("ret_long").alias("ret_total"),
        F.product(1 + F.col("ret_long")).over(w).alias("nav"),
        "n_long",
    )


def trade_log(moves: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Buys and sells with the raw entry price of the holding run and the executed price.

    A run is a stretch of consecutive held days; its entry is the open of its
    first day. An entity has at most one row per day.
    """
    w = Window.partitionBy("entity").orderBy("ord")
    run = F.sum(F.when(F.col("path") == "add", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_run = Window.partitionBy("entity", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = moves.where("path <> 'keep'").withColumn("_run", run).withColumn("entry_price", F.first("open").over(in_run))
    action = F.when(F.col("path") == "add", "BUY").otherwise("SELL")
    price = F.when(F.col("path") == "add", F.col("open") * (1 + costs.buy)).otherwise(F.col("open") * (1 - costs.sell))
    log = rows.select("date", "entity", action.alias("action"), "entry_price", price.alias("exec_price"))
    return log.where("action = 'SELL' OR entry_price IS NOT NULL")
