"""Trailing-window expressions over one entity's rows in date order.

All of them share one window specification, so Spark sorts each entity once.
An entity's group never outgrows the calendar: the panel holds one row per
entity and day.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.fixed_values import EPS
from tapeloom.functions.scalars import col, over

def ordered(*keys: str, date: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("entity",))).orderBy(date)


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or ordered()).rowsBetween(-(n - 1), Window.currentRow)


def up_to_now(w: WindowSpec | None = None) -> WindowSpec:
    return (w or ordered()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling_mean(c, n: int, w=None) -> Column:
    return F.avg(col(c)).over(last_n(n, w))


def rolling_sum(c, n: int, w=None) -> Column:
    return F.sum(col(c)).over(last_n(n, w))


def rolling_max(c, n: int, w=None) -> Column:
    return F.max(col(c)).over(last_n(n, w))


def rolling_min(c, n: int, w=None) -> Column:
    return F.min(col(c)).over(last_n(n, w))


def rolling_std(c, n: int, w=None) -> Column:
    """Sample deviation; a single observation gives NULL."""
    return F.stddev_samp(col(c)).over(last_n(n, w))


def rolling_skew(c, n: int, w=None) -> Column:
    """Bias-corrected skewness of three or more observations; NaN when they are all equal."""
    frame = last_n(n, w)
    count = F.count(col(c)).over(frame)
    return F.skewness(col(c)).over(frame) * F.sqrt(count * (count - 1)) / F.nullif(F.greatest(count - 2, F.lit(0)), F.lit(0))


def rolling_kurtosis(c, n: int, w=None) -> Column:
    """Bias-corrected excess kurtosis of four or more observations; NaN when they are all equal."""
    frame = last_n(n, w)
    count = F.count(col(c)).over(frame)
    enough = F.nullif(F.greatest(count - 3, F.lit(0)), F.lit(0))
    return (count - 1) / ((count - 2) * enough) * ((count + 1) * F.kurtosis(col(c)).over(frame) + 6)


def rolling_corr(a, b, n: int, w=None) -> Column:
    """Correlation of the complete pairs in the window; NULL when a side is constant."""
    frame = last_n(n, w)
    dev_a = F.stddev_samp(F.when(col(b).isNotNull(), col(a))).over(frame)
    dev_b = F.stddev_samp(F.when(col(a).isNotNull(), col(b))).over(frame)
    return F.try_divide(F.covar_samp(col(a), col(b)).over(frame), dev_a * dev_b)


def rolling_zscore(c, n: int, w=None) -> Column:
    return over(col(c) - rolling_mean(c, n, w), rolling_std(c, n, w))


def shifted(c, k: int = 1, w=None) -> Column:
    return F.lag(col(c), k).over(w or ordered())


def forward_fill(c, w=None) -> Column:
    return F.last(col(c), ignorenulls=True).over(up_to_now(w))


def pct_change(filled, n: int = 1, w=None) -> Column:
    """Relative change over ``n`` rows of a column that is already forward filled."""
    return F.try_divide(col(filled), shifted(filled, n, w)) - 1


def true_range(high="high", low="low", prev_close="prev_close") -> Column:
    high, low, prev = col(high), col(low), col(prev_close)
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def running_product(c, w=None) -> Column:
    return F.product(col(c)).over(up_to_now(w))


def running_max(c, w=None) -> Column:
    return F.max(col(c)).over(up_to_now(w))


def rank_of_last(c, n: int, min_rows: int, w=None) -> Column:
    """Share rank (average ties) of the newest value among the last ``n`` rows."""
    values = F.collect_list(col(c)).over(last_n(n, w))
    count = F.size(values)
    below = F.size(F.filter(values, lambda v: v < col(c)))
    equal = F.size(F.filter(values, lambda v: v == col(c)))
    return F.when(col(c).isNotNull() & (count >= min_rows), (below + (equal + 1) / 2) / count)


def number_rows(df: DataFrame, key: str = "entity", date: str = "date", block: int = 500) -> DataFrame:
    """Add the row number within the entity and the block of rows it falls in."""
    df = df.withColumn("_row", F.row_number().over(ordered(key, date=date)) - 1)
    return df.withColumns({"_block": F.floor(F.col("_row") / block), "_closes": F.col("_row") % block == block - 1})


def smooth(df: DataFrame, specs: Mapping[str, tuple[str, int]], key: str = "entity", date: str = "date") -> DataFrame:
    """Add exponential means ``{output: (input, span)}`` to numbered rows.

    With ``q = 1 - 2/(span+1)`` the recursion unrolls to a weighted sum of past
    values. Weights are kept relative to the start of a block of rows, so powers
    of ``1/q`` stay finite however long the history is; finished blocks enter
    through their end values, each decayed by the observations since then. The
    mean starts at the first observation and holds its value where the input is
    missing. All windows sort by entity, block and date, so one sort serves them.
    """
    w = Window.partitionBy(key).orderBy("_block", date)
    whole = Window.partitionBy(key, "_block")
    within = whole.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sources = sorted({source for source, _ in specs.values()})
    df = df.withColumns({f"_t_{s}": F.count(col(s)).over(up_to_now(w)) - 1 for s in sources})
    df = df.withColumns({f"_b_{s}": F.greatest(F.min(f"_t_{s}").over(whole), F.lit(0)) for s in sources})

    local, ends, finished = {}, {}, {}
    for out, (source, span) in specs.items():
        q = 1.0 - 2.0 / (span + 1.0)
        t, start = F.col(f"_t_{source}"), F.col(f"_b_{source}")
        weight = F.when(t == 0, F.lit(1.0)).otherwise(F.lit(1.0 - q))
        term = col(source) * weight * F.pow(F.lit(q), start - t)
        local[f"_l_{out}"] = F.pow(F.lit(q), t - start) * F.coalesce(F.sum(term).over(within), F.lit(0.0))
        end = F.struct(t.alias("t"), F.col(f"_l_{out}").alias("v"))
        ends[f"_e_{out}"] = F.collect_list(F.when(F.col("_closes") & (t >= 0), end)).over(before)
        finished[out] = F.when(t >= 0, F.col(f"_l_{out}") + _carried(F.col(f"_e_{out}"), t, q))
    helpers = [f"_{k}_{s}" for s in sources for k in "tb"] + [f"_{k}_{o}" for o in specs for k in "le"]
    return df.withColumns(local).withColumns(ends).withColumns(finished).drop(*helpers)


def with_ema(df: DataFrame, specs: Mapping[str, tuple[str, int]], key: str = "entity", date: str = "date") -> DataFrame:
    """Exponential means by :func:`smooth`, with the row numbers added and removed."""
    return smooth(number_rows(df, key, date), specs, key, date).drop("_row", "_block", "_closes")


def _carried(ends: Column, now: Column, q: float) -> Column:
    """What finished blocks still weigh: their end values, decayed to ``now``."""
    return F.aggregate(ends, F.lit(0.0), lambda acc, e: acc + e["v"] * F.pow(F.lit(q), now - e["t"]))


def gains_and_losses(close: str = "close", key: str = "entity") -> dict[str, Column]:
    move = col(close) - shifted(close, 1, ordered(key))
    return {"_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
            "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))}


def rsi_specs(spans) -> dict[str, tuple[str, int]]:
    return {f"_{side}{n}": (f"_{side}", n) for n in spans for side in ("gain", "loss")}


def rsi_values(spans) -> dict[str, Column]:
    return {f"rsi{n}": 100 - 100 / (1 + F.col(f"_gain{n}") / (F.col(f"_loss{n}") + F.lit(EPS))) for n in spans}


def with_rsi(df: DataFrame, spans: tuple[int, ...] = (14, 5), close: str = "close", key: str = "entity") -> DataFrame:
    """Add ``rsi{n}``: balance of smoothed gains and losses."""
    specs = rsi_specs(spans)
    df = with_ema(df.withColumns(gains_and_losses(close, key)), specs, key)
    return df.withColumns(rsi_values(spans)).drop("_gain", "_loss", *specs)


def with_macd(df: DataFrame, fast=12, slow=26, signal=9, close: str = "close", key: str = "entity") -> DataFrame:
    """Add ``macd_dif``, ``macd_dea`` and ``macd_hist``."""
    df = smooth(number_rows(df, key), {"_fast": (close, fast), "_slow": (close, slow)}, key)
    df = smooth(df.withColumn("macd_dif", F.col("_fast") - F.col("_slow")), {"macd_dea": ("macd_dif", signal)}, key)
    out = df.withColumn("macd_hist", F.col("macd_dif") - F.col("macd_dea"))
    return out.drop("_fast", "_slow", "_row", "_block", "_closes")


def bollinger(c="close", n: int = 20, k: float = 2.0, w=None) -> dict[str, Column]:
    """Middle, upper and lower band, band width and position inside the band."""
    mid, dev = rolling_mean(c, n, w), rolling_std(c, n, w)
    upper, lower = mid + k * dev, mid - k * dev
    return {
        f"boll_ma{n}": mid,
        "boll_upper": upper,
        "boll_lower": lower,
        "boll_width": over(upper - lower, mid),
        "boll_pctb": over(col(c) - lower, upper - lower),
    }
