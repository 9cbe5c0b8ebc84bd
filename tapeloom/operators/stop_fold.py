"""Stop rules walked over the days of many names and settings at once.

Names lie together and in date order in their partition and arrive as Arrow batches. Whole names are taken in runs of
bounded size, and their first, second, third ... days are moved together as arrays of names x settings, so Python does
one step per day and run, not one per name, day and setting. The events are those of
:func:`tapeloom.operators.stops.advance`, which streams use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tapeloom.config import Costs, Stops

CELLS = 1 << 18  # days of names times settings walked together; bounds the memory of a run, one name at the least
EVENTS = (
    "param_id string, entity string, date date, kind string, path string, weight double, ret double, "
    "contribution double, entry_price double, exec_price double"
)
KINDS = np.array(["", "SL", "TP", "TRAIL_SL", "BUY", "SELL", "RET"], dtype=object)
SL, TP, TRAIL, BUY, SELL, RET = range(1, 7)
PATHS = np.array(["add", "keep", "reduce", "stop"], dtype=object)
ADD, KEEP, REDUCE, STOP = range(4)
PRICES = ("open", "high", "low", "close", "prev_close")
UNKNOWN = np.nan  # a price, day or signal that is not there: every comparison with it is false


class Day:
    """One day of each of some names, as columns that meet the settings in rows."""

    def __init__(self, columns: dict[str, np.ndarray], rows: np.ndarray) -> None:
        for name, values in columns.items():
            setattr(self, name, values[rows, None])
        self.known = np.isfinite(self.open) & np.isfinite(self.high) & np.isfinite(self.low)


class Grid:
    """Settings with the same rules, as one array per parameter."""

    def __init__(self, settings: list[tuple[str, Stops]]) -> None:
        self.names = np.array([name for name, _ in settings], dtype=object)
        for field in ("take_profit", "stop_loss", "cooldown_days", "trail_start", "trail_drawdown"):
            setattr(self, field, np.array([getattr(s, field) for _, s in settings], dtype=float))
        self.block = np.array([s.block_reentry_returns for _, s in settings], dtype=bool)
        self.rules = [RULES[r.lower()] for r in settings[0][1].rules if r.lower() in RULES]


class Holdings:
    """What is remembered between days, names x settings."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.weight = np.zeros(shape)
        self.last_ord = np.full((shape[0], 1), -2)
        self.entry, self.peak, self.stop_day, self.stop_signal = (np.full(shape, UNKNOWN) for _ in range(4))
        self.armed, self.closed = np.zeros(shape, bool), np.zeros(shape, bool)

    def first(self, n: int) -> Holdings:
        """The first names, sharing memory with all."""
        part = object.__new__(Holdings)
        part.__dict__ = {name: values[:n] for name, values in self.__dict__.items()}
        return part

    def forget(self, where: np.ndarray) -> None:
        self.entry[where], self.peak[where], self.armed[where] = UNKNOWN, UNKNOWN, False


def _fixed(held: Holdings, day: Day, grid: Grid, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stop-loss is looked at before take-profit; a gap through the level fills at the open."""
    held.entry[:] = np.where(on & np.isnan(held.entry), day.open, held.entry)
    floor, ceiling = held.entry * (1 - grid.stop_loss), held.entry * (1 + grid.take_profit)
    loss = on & day.known & (day.low <= floor)
    gain = on & day.known & ~loss & (day.high >= ceiling)
    return np.select([loss, gain], [SL, TP]), np.where(loss, np.minimum(day.open, floor), np.maximum(day.open, ceiling))


def _trailing(held: Holdings, day: Day, grid: Grid, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Armed by a rise over the entry; then a fall from the peak exits, first at the open, then intraday."""
    able, keep = on & day.known, 1 - grid.trail_drawdown
    held.entry[:] = np.where(able & np.isnan(held.entry), day.open, held.entry)
    live = able & (held.entry > 0)
    fresh = live & np.isnan(held.peak)
    held.peak[:] = np.where(fresh, held.entry, held.peak)
    held.armed[:] = (held.armed & ~fresh) | (live & (day.high / held.entry - 1 >= grid.trail_start))
    acting = live & held.armed
    top = np.maximum(held.peak, day.high)
    at_open = acting & (day.open <= held.peak * keep)
    hit = at_open | (acting & (1 - day.low / top >= grid.trail_drawdown))
    held.peak[:] = np.where(acting & ~hit, top, held.peak)
    return np.where(hit, TRAIL, 0), np.where(at_open, day.open, top * keep)


RULES: dict[str, Callable] = {"fixed_tp_sl": _fixed, "trailing_sl": _trailing}


def move(held: Holdings, day: Day, grid: Grid, costs: Costs) -> list[tuple[np.ndarray, ...]]:
    """Moves names through one day under all settings; returns where events lie and what they say.

    An event list is ``(where, kind, path, weight, ret, entry_price, exec_price)``.
    """
    gap = day.ord != held.last_ord + 1  # a day without the name lies in between
    held.weight[gap[:, 0]] = 0.0
    held.forget(gap & ~np.isnan(held.entry))
    held.last_ord[:] = day.ord
    before = held.weight.copy()
    since = day.day - held.stop_day
    blocked = held.stop_signal == day.signal
    none = ((since >= 0) & (since <= grid.cooldown_days)) | (blocked & grid.block & (before == 0))
    target = np.where(none, 0.0, day.weight)

    buys = (target != 0) & (before == 0) & ~blocked & np.isfinite(day.open)
    held.entry[:], held.peak[:] = np.where(buys, day.open, held.entry), np.where(buys, day.open, held.peak)
    held.armed &= ~buys
    held.closed &= ~buys

    both = (target != 0) & (before != 0)
    code, raw = np.zeros(target.shape, int), np.full(target.shape, UNKNOWN)
    for rule in grid.rules:
        found, price = rule(held, day, grid, both & (code == 0))
        raw = np.where(found > 0, price, raw)
        code = np.where(found > 0, found, code)
    stopped = code > 0
    counted = stopped & (before > 0) & np.isfinite(day.prev_close) & (day.prev_close > 0)

    adds, keeps, reduces = (target != 0) & (before == 0), both & ~stopped, (target == 0) & (before != 0)
    sold = reduces & ~held.closed
    leaves = stopped | reduces
    price = np.where(stopped, raw, day.open) * (1 - costs.sell)
    paid = day.open * (1 + costs.buy)
    ret = np.where(adds, day.close / paid, np.where(leaves, price, day.close) / day.prev_close) - 1
    path = np.select([counted, adds, keeps], [STOP, ADD, KEEP], REDUCE)
    empty = np.broadcast_to(UNKNOWN, target.shape)
    events = [(counted | adds | keeps | reduces, np.full(target.shape, RET), path, np.where(leaves, before, target), ret, empty, empty)]
    traded = buys | counted | sold
    if traded.any():
        kind = np.select([buys, counted], [BUY, code], SELL)
        events.append((traded, kind, path, empty, empty, held.entry.copy(), np.where(buys, paid, price)))

    held.entry[stopped] = UNKNOWN
    trailed = code == TRAIL
    held.peak[trailed], held.armed[trailed] = UNKNOWN, False
    held.closed |= stopped
    held.stop_day[:], held.stop_signal[:] = np.where(stopped, day.day, held.stop_day), np.where(stopped, day.signal, held.stop_signal)
    target = np.where(stopped, 0.0, target)
    held.forget(sold | (~np.isnan(held.entry) & (target == 0) & (before == 0)))
    held.weight[:] = target
    return events


def _walk(frame: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, grid: Grid, costs: Costs) -> pd.DataFrame:
    """All events of some whole names: their days move together, longest names first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    columns = {c: frame[c].to_numpy(dtype=float) for c in ("weight", *PRICES)} | {c: frame[c].to_numpy() for c in ("ord", "day", "signal")}
    held, out = Holdings((len(starts), len(grid.names))), []
    with np.errstate(all="ignore"):
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # names with more than i days
            rows = starts[:n] + i
            for where, *said in move(held.first(n), Day(columns, rows), grid, costs):
                names, settings = np.nonzero(where)
                out.append((settings, rows[names], *(x[names, settings] for x in said)))
    setting, row, kind, path, weight, ret, entry, price = (np.concatenate(x) for x in zip(*out))
    ret = np.where(np.isfinite(ret), ret, UNKNOWN)
    values = (grid.names[setting], frame["entity"].to_numpy()[row], frame["date"].to_numpy()[row], KINDS[kind], PATHS[path],
              weight, ret, weight * ret, entry, price)
    return pd.DataFrame(dict(zip((f.split()[0] for f in EVENTS.split(", ")), values)))


def _runs(frame: pd.DataFrame, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and sizes of names, in runs of at most ``CELLS`` cells, one name at the least."""
    sizes = np.diff(np.append(starts, len(frame)))
    at = 0
    while at < len(starts):
        filled = np.cumsum(sizes[at:]) * width
        end = at + max(1, int(np.searchsorted(filled, CELLS, side="right")))
        yield starts[at:end], sizes[at:end]
        at = end


def fold(days: DataFrame, settings: Iterable[tuple[str, Stops]], costs: Costs) -> DataFrame:
    """Events of every name under every setting, from days as :func:`tapeloom.operators.stops.stop_days` gives them.

    Names are shuffled and sorted once, whatever the number of settings. Missing prices may be null or not finite.
    A task holds one Arrow batch, the days of a name that it cuts, and the events of one run.
    """
    by_rules: dict[tuple[str, ...], list[tuple[str, Stops]]] = {}
    for name, s in settings:
        by_rules.setdefault(tuple(s.rules), []).append((name, s))

    def whole_names(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for some in by_rules.values():
            grid = Grid(some)
            for run in _runs(frame, starts, len(some)):
                yield _walk(frame, *run, grid, costs)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for batch in batches:
            frame = batch if left is None else pd.concat([left, batch], ignore_index=True)
            if not len(frame):
                continue
            names = pd.factorize(frame["entity"], use_na_sentinel=False)[0]
            starts = np.flatnonzero(np.diff(names, prepend=-1))
            cut = starts[-1]  # the last name may go on in the next batch
            if cut:
                yield from whole_names(frame.iloc[:cut], starts[:-1])
            left = frame.iloc[cut:].reset_index(drop=True)
        if left is not None:
            yield from whole_names(left, np.array([0]))

    return days.repartition("entity").sortWithinPartitions("entity", "ord").mapInPandas(walk, EVENTS)
