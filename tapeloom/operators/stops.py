"""Portfolio returns with take-profit, stop-loss, trailing stop and cooldown.

Whether a name is stopped depends only on its own bars and on the signal date
of the day, so names are independent: the days of many names are walked in
date order together, under every setting of a grid (``stop_fold``), and added
up by date afterwards. :func:`advance` moves one name by one day; streams, whose
state is kept between batches, use it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import Costs, Stops
from tapeloom.operators.evaluation import performance
from tapeloom.operators.simulate import daily_nav, market_days, transitions
from tapeloom.operators.stop_fold import fold


@dataclass
class Bar:
    """One trading day of one name."""

    day: int
    ord: int
    signal: int
    target: float
    open: float
    high: float
    low: float
    close: float
    prev_close: float


@dataclass
class Holding:
    """What is remembered about one name between days."""

    weight: float = 0.0
    last_ord: int = -2
    entry: float | None = None
    peak: float | None = None
    armed: bool = False
    closed_by_stop: bool = False
    stop_day: int | None = None
    stop_signal: int | None = None


def _known(*values: float) -> bool:
    return all(math.isfinite(v) for v in values)


def _change(price: float, base: float) -> float:
    return price / base - 1 if base else math.nan


def fixed_rule(held: Holding, bar: Bar, stops: Stops):
    """Stop-loss is looked at before take-profit; a gap through the level fills at the open."""
    if not _known(bar.open):
        return None
    if held.entry is None:
        held.entry = bar.open
    if not _known(bar.high, bar.low):
        return None
    floor, ceiling = held.entry * (1 - stops.stop_loss), held.entry * (1 + stops.take_profit)
    if bar.low <= floor:
        return "SL", min(bar.open, floor)
    if bar.high >= ceiling:
        return "TP", max(bar.open, ceiling)
    return None


def trailing_rule(held: Holding, bar: Bar, stops: Stops):
    """Armed by a rise over the entry; then a fall from the peak exits, first at the open, then intraday.

    Before arming the peak stays where it was, so the first armed day is judged
    against the entry at its open.
    """
    if not _known(bar.open, bar.high, bar.low):
        return None
    if held.entry is None:
        held.entry = bar.open
    if held.entry <= 0:
        return None
    if held.peak is None:
        held.peak, held.armed = held.entry, False
    if not held.armed and bar.high / held.entry - 1 >= stops.trail_start:
        held.armed = True
    if not held.armed:
        return None
    keep = 1 - stops.trail_drawdown
    if bar.open <= held.peak * keep:
        return "TRAIL_SL", bar.open
    peak = max(held.peak, bar.high)
    if 1 - bar.low / peak >= stops.trail_drawdown:
        return "TRAIL_SL", peak * keep
    held.peak = peak
    return None


RULES: dict[str, Callable] = {"fixed_tp_sl": fixed_rule, "trailing_sl": trailing_rule}


def advance(held: Holding, bar: Bar, stops: Stops, costs: Costs) -> list[tuple]:
    """Move one name through one day; returns its return and trade events.

    An event is ``(kind, path, weight, ret, entry_price, exec_price)``.
    """
    events: list[tuple] = []
    if bar.ord != held.last_ord + 1:  # a day without this name lies in between
        held.weight = 0.0
        if held.entry is not None:
            held.entry, held.peak, held.armed = None, None, False
    held.last_ord = bar.ord
    before, target = held.weight, bar.target
    if held.stop_day is not None and 0 <= bar.day - held.stop_day <= stops.cooldown_days:
        target = 0.0
    blocked = held.stop_signal is not None and held.stop_signal == bar.signal
    if blocked and stops.block_reentry_returns and before == 0:
        target = 0.0

    if target and not before and not blocked and _known(bar.open):
        held.entry, held.peak, held.armed = bar.open, bar.open, False
        held.closed_by_stop = False
        events.append(("BUY", "add", None, None, bar.open, bar.open * (1 + costs.buy)))

    stopped = False
    if target and before:
        for name in stops.rules:
            rule = RULES.get(name.lower())
            hit = rule(held, bar, stops) if rule else None
            if hit is None:
                continue
            action, raw = hit
            price = raw * (1 - costs.sell)
            if before > 0 and _known(bar.prev_close) and bar.prev_close > 0:
                events.append(("RET", "stop", before, price / bar.prev_close - 1, None, None))
                events.append((action, "stop", None, None, held.entry, price))
            held.entry = None
            if action == "TRAIL_SL":
                held.peak, held.armed = None, False
            held.closed_by_stop, held.stop_day, held.stop_signal = True, bar.day, bar.signal
            target, stopped = 0.0, True
            break

    if not stopped:
        if target and not before:
            events.append(("RET", "add", target, _change(bar.close, bar.open * (1 + costs.buy)), None, None))
        elif target:
            events.append(("RET", "keep", target, _change(bar.close, bar.prev_close), None, None))
        elif before:
            price = bar.open * (1 - costs.sell)
            events.append(("RET", "reduce", before, _change(price, bar.prev_close), None, None))
            if not held.closed_by_stop:
                events.append(("SELL", "reduce", None, None, held.entry, price))
                held.entry, held.peak, held.armed = None, None, False
    if held.entry is not None and not target and not before:
        held.entry, held.peak, held.armed = None, None, False
    held.weight = target
    return events


def stop_days(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Transitions with the signal date of each day, ready to be walked."""
    signals = positions.groupBy("date").agg(F.min("signal_date").alias("signal_date"))
    moves = transitions(positions, bars).join(F.broadcast(signals), "date", "left")
    known = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    prices = [known(c) for c in ("open", "high", "low", "close", "prev_close")]
    return moves.select(
        "entity", "date", F.unix_date("date").alias("day"), "ord",
        F.coalesce(F.unix_date("signal_date"), F.lit(-1)).alias("signal"), "weight", *prices,
    )


def simulate(positions: DataFrame, bars: DataFrame, settings: Iterable[tuple[str, Stops]], costs: Costs = Costs()) -> DataFrame:
    """Return and trade events of every name under each named stop setting."""
    return fold(stop_days(positions, bars), settings, costs)


def returns_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'RET'").select("param_id", "date", "entity", "path", "weight", "ret", "contribution")


def trades_of(events: DataFrame) -> DataFrame:
    return events.where("kind <> 'RET'").select("param_id", "date", "entity", F.col("kind").alias("action"), "entry_price", "exec_price")


def stopped_nav(events: DataFrame, positions: DataFrame, bars: DataFrame, names: Iterable[str]) -> DataFrame:
    """NAV of every named setting, with a row for each market day, held or not."""
    every = market_days(positions, bars).select("date", F.explode(F.array(*map(F.lit, names))).alias("param_id"))
    return daily_nav(returns_of(events), ("param_id",), every)


def grid(take_profits: Iterable[float], stop_losses: Iterable[float], cooldowns: Iterable[float]) -> list[tuple[str, Stops]]:
    """Named settings of a parameter sweep."""
    return [
        (f"tp={tp:g}|sl={sl:g}|cd={cd:g}", Stops(take_profit=tp, stop_loss=sl, cooldown_days=cd))
        for tp in take_profits for sl in stop_losses for cd in cooldowns
    ]


def sweep(positions: DataFrame, bars: DataFrame, settings: Sequence[tuple[str, Stops]], costs: Costs = Costs(), freq: int = 252) -> DataFrame:
    """Sharpe ratio of every setting, from one pass over the data."""
    nav = stopped_nav(simulate(positions, bars, settings, costs), positions, bars, [name for name, _ in settings])
    stats = performance(nav.select("param_id", "date", F.col("ret_total").alias("ret")), ("param_id",), freq)
    parts = F.split("param_id", r"\|")
    value = lambda i: F.substring_index(parts[i], "=", -1).cast("double")
    return stats.select(
        value(0).alias("take_profit"), value(1).alias("stop_loss"), value(2).alias("cooldown_days"), "sharpe"
    )


def sweep_table(results: DataFrame, cooldowns: Sequence[float]) -> DataFrame:
    """Sharpe by take-profit and stop-loss, one column per cooldown."""
    names = [f"cd_{c:g}" for c in cooldowns]
    cells = [F.max(F.when(F.col("cooldown_days") == c, F.col("sharpe"))).alias(n) for c, n in zip(cooldowns, names)]
    return results.groupBy("take_profit", "stop_loss").agg(*cells)
