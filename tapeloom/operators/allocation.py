"""Two-asset allocation: market environment score, weight paths, combined return.

Inputs are series keyed by ``entity`` with one row per day or week.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import Allocation
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import clip
from tapeloom.operators.crosssection import with_quantiles
from tapeloom.operators.labels import asset_week_returns, own_alignment
from tapeloom.session import cut_lineage


def quintiles(df: DataFrame, value: str, out: str, look_ahead: bool = True, key: str = "entity") -> DataFrame:
    """Label 1..5 of a value in [0, 1].

    With ``look_ahead`` the cuts are the quintiles of the whole series if it
    has 20 values and distinct cuts; otherwise, or without it, fixed fifths.
    """
    fixed = 1 + sum((F.col(value) > b).cast("int") for b in (0.2, 0.4, 0.6, 0.8))
    if not look_ahead:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), fixed))
    names = [f"_c{i}" for i in range(6)]
    cuts = with_quantiles(df, [key], value, {n: i / 5 for i, n in enumerate(names)})
    counts = df.groupBy(key).agg(F.count(value).alias("_n"))
    edges = F.array(*names)
    usable = (F.col("_n") >= 20) & (F.size(F.array_distinct(edges)) == 6)
    binned = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(value))), F.lit(1))
    joined = df.join(counts, key).join(cuts, key, "left")
    label = F.when(F.col(value).isNotNull(), F.when(usable, binned).otherwise(fixed))
    return joined.withColumn(out, label).select(*df.columns, out)


def environment_ranks(bars: DataFrame) -> DataFrame:
    """Rolling share ranks of 20-day volatility and of up days, carried forward."""
    df = bars.select("entity", "date", "close").withColumn("_cf", R.forward_fill("close"))
    df = df.withColumn("_r", F.coalesce(R.pct_change("_cf"), F.lit(0.0)))
    full = F.count("_r").over(R.last_n(20)) >= 20
    df = df.withColumns(
        {"_vol": F.when(full, R.rolling_std("_r", 20) * math.sqrt(252)), "_up": F.when(F.col("_r") > 0, 1.0).otherwise(0.0)}
    )
    df = df.withColumns({"_vr": R.rank_of_last("_vol", 252, 60), "_br": R.rank_of_last("_up", 252, 60)})
    return df.select("entity", "date", "close", R.forward_fill("_vr").alias("vol_rank"), R.forward_fill("_br").alias("breadth_rank"))


def base_strength(bars: DataFrame, weeks: DataFrame, cfg: Allocation = Allocation(), look_ahead: bool = True) -> DataFrame:
    """Environment score per series and week end, before the direction adjustment."""
    ranks = cut_lineage(environment_ranks(bars))  # read several times below
    labelled = quintiles(ranks, "vol_rank", "vol_q", look_ahead)
    labelled = quintiles(labelled, "breadth_rank", "breadth_q", look_ahead)
    aligned = own_alignment(bars, weeks).select("entity", F.col("date").alias("week"), F.col("day").alias("date"))
    at = aligned.join(labelled, ["entity", "date"]).select(
        "entity", F.col("week").alias("date"), F.coalesce("vol_q", F.lit(3)).alias("v"), F.coalesce("breadth_q", F.lit(3)).alias("b")
    )
    span = max(1.0, float(cfg.vol_high - cfg.vol_low))
    env = F.when(F.col("v") <= cfg.vol_low, 1.0).when(F.col("v") >= cfg.vol_high, 0.0).otherwise((cfg.vol_high - F.col("v")) / span)
    extra = F.when(F.col("b") == 5, cfg.wide_penalty).when(F.col("b") == 1, cfg.narrow_penalty)
    return at.select("entity", "date", F.when(extra.isNotNull(), F.least(F.lit(1.0), env + extra)).otherwise(env).alias("env_base"))


def environment(bars: DataFrame, weeks: DataFrame, cfg: Allocation = Allocation(), look_ahead: bool = True) -> DataFrame:
    """Environment score with the direction adjustment.

    The weekly return filed under a week end runs to the next one; without
    ``look_ahead`` it is filed where it ends.
    """
    base = base_strength(bars, weeks, cfg, look_ahead)
    weekly = asset_week_returns(bars, weeks, "c2c")
    if not look_ahead:
        ends = weeks.select(F.col("date").alias("sample_date"), "next_week_end")
        weekly = weekly.join(ends, "sample_date").select("entity", F.col("next_week_end").alias("sample_date"), "ret")
    n = cfg.direction_weeks
    w = R.last_n(n, R.ordered("entity", date="sample_date"))
    moved = weekly.select("entity", F.col("sample_date").alias("date"), F.when(F.count("ret").over(w) >= n, F.sum("ret").over(w)).alias("_x"))
    x, e = F.col("_x"), F.col("env_base")
    adjusted = F.when(x > cfg.direction_up, e * cfg.soften).when(x < cfg.direction_down, F.least(F.lit(1.0), e + cfg.harden)).otherwise(e)
    return base.join(moved, ["entity", "date"], "left").select("entity", "date", "env_base", clip(adjusted, 0.0, 1.0).alias("env_strength"))


NEUTRAL, ATTACK, DEFENSE = 0, 1, 2


def _target(cfg: Allocation, e: Column, state: Column) -> Column:
    """Target weight of the second asset."""
    if cfg.mode == "linear":
        return F.lit(cfg.w_min) + F.lit(cfg.w_max - cfg.w_min) * e
    span = cfg.state_high - cfg.state_low
    share = F.lit(0.5) if span == 0 else clip((e - cfg.state_low) / span, 0.0, 1.0)
    low, high = cfg.w_neutral
    return F.when(state == NEUTRAL, low + (high - low) * share).when(state == ATTACK, F.lit(cfg.w_attack)).otherwise(F.lit(cfg.w_defense))


def _next_state(cfg: Allocation, e: Column, state: Column, streak: Column) -> tuple[Column, Column]:
    """State and streak after a week: a state is left for the middle at once, and entered after enough weeks that ask for it."""
    calm, tense = e <= cfg.state_low, e >= cfg.state_high
    asked = F.when(calm & (state != ATTACK), ATTACK).when(tense & (state != DEFENSE), DEFENSE)
    middle = ~calm & ~tense
    entered = asked.isNotNull() & (streak + 1 >= cfg.hysteresis_weeks)
    after = F.when(middle, NEUTRAL).when(entered, asked).otherwise(state)
    count = F.when(middle | entered, 0).when(asked.isNotNull(), streak + 1).otherwise(streak)
    return after, count


def weight_path(env: DataFrame, cfg: Allocation = Allocation()) -> DataFrame:
    """Weekly weights: target, smoothing towards it, and a cap on the weekly change.

    Each week depends on the one before, so a series (a few thousand weeks at most) is folded in order inside its row;
    many series run in parallel. A missing environment keeps the previous one, 0.5 at the start.
    """
    so_far = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = env.select("entity", "date", F.coalesce(F.last("env_strength", ignorenulls=True).over(so_far), F.lit(0.5)).cast("double").alias("e"))
    weeks = filled.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date", "e"))).alias("weeks"))

    def step(acc: Column, week: Column) -> Column:
        e, weight = week["e"], acc["w"]
        smooth = (1 - cfg.smooth) * _target(cfg, e, acc["state"]) + cfg.smooth * weight
        new = clip(F.least(F.greatest(smooth, weight - cfg.weekly_cap), weight + cfg.weekly_cap), 0.0, 1.0)
        state, streak = _next_state(cfg, e, acc["state"], acc["streak"])
        return F.struct(new.alias("w"), state.cast("int").alias("state"), streak.cast("int").alias("streak"), F.concat(acc["path"], F.array(new)).alias("path"))

    start = F.struct(F.lit(cfg.w_min).cast("double").alias("w"), F.lit(NEUTRAL).alias("state"), F.lit(0).alias("streak"), F.array().cast("array<double>").alias("path"))
    walked = weeks.select("entity", "weeks", F.aggregate("weeks", start, step, lambda acc: acc["path"]).alias("path"))
    return walked.select("entity", F.explode(F.arrays_zip(F.col("weeks.date").alias("date"), F.col("path").alias("w_g"))).alias("x")).select(
        "entity", "x.date", "x.w_g")


def combined(df: DataFrame, cfg: Allocation = Allocation(), keys: Sequence[str] = ()) -> DataFrame:
    """Combined return of ``date, ret_s, ret_g, w_g`` with weights set one period earlier; each series (``keys``) on its own."""
    w = Window.partitionBy(*keys).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    main = F.coalesce("ret_s", F.lit(0.0))
    raw = F.lag(1 - F.col("w_g")).over(w) * main + F.lag("w_g").over(w) * F.col("ret_g") * (1 - cfg.costs.buy)
    out = df.withColumns({"ret_combo": F.coalesce(raw, F.lit(0.0)), "ret_s": main})
    return out.select(
        *keys, "date", "ret_s", "ret_g", "ret_combo", (1 - F.col("w_g")).alias("w_s"), "w_g",
        F.product(1 + F.col("ret_s")).over(so_far).alias("nav_s"),
        F.product(1 + F.coalesce("ret_g", F.lit(0.0))).over(so_far).alias("nav_g"),
        F.product(1 + F.col("ret_combo")).over(so_far).alias("nav_combo"),
    )
