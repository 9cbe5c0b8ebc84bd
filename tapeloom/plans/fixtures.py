"""Panels and derived inputs shared by the registered queries.

The stages of the pipeline hand over stored tables: bars, labels, scores and
positions are written once per session under the shared checkpoint folder and
read back, so a plan that needs bars in five places scans five columns of a
parquet file and does not aggregate the order lines five times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import Costs, Selection, UniverseRules
from tapeloom.fixed_values import FACTOR_COLUMNS
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import finite
from tapeloom.operators import simulate as M
from tapeloom.operators import store
from tapeloom.operators.aggregates import context_features, sector_bars
from tapeloom.operators.calendar import week_ends
from tapeloom.operators.factors import technical_factors
from tapeloom.operators.labels import weekly_labels
from tapeloom.operators.selection import daily_positions, rebalance_plan, select_names
from tapeloom.operators.universe import rule_columns
from tapeloom.session import shared_dir
from tapeloom.sources import bars as B
from tapeloom.sources.upsert import dimension_ids

_WRITTEN: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, root: str, name: str) -> str:
    """A place under the shared folder for one session, input folder and name."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{hashlib.md5(root.encode()).hexdigest()[:12]}/{name}"


def stored(name: str) -> Callable:
    """Write the decorated table once per session and input folder, then read it back."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def load(spark: SparkSession, root: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, root, name)
            if key not in _WRITTEN:
                path = scratch(spark, root, name)
                build(spark, root).write.mode("overwrite").parquet(path)
                _WRITTEN[key] = path
            return spark.read.parquet(_WRITTEN[key])

        return load

    return wrap


def forget() -> None:
    """Make the next use write every table again."""
    _WRITTEN.clear()


bars = stored("bars")(B.brand_bars)
thin_bars = stored("thin_bars")(B.supplier_bars)
# For queries that read the bars once: not stored, so only the columns they use are aggregated and shuffled.
thin_rows = B.supplier_bars
indices = stored("indices")(B.index_bars)
calendar = stored("calendar")(B.calendar_days)


@stored("weeks")
def weeks(spark: SparkSession, root: str) -> DataFrame:
    return week_ends(calendar(spark, root))


@stored("scores")
def scores(spark: SparkSession, root: str) -> DataFrame:
    """Twenty-row momentum of the close on week-end dates."""
    momentum = bars(spark, root).select(
        "entity", "date", finite(F.col("close") / R.shifted("close", 20) - 1).alias("score")
    )
    ends = weeks(spark, root).select("date")
    return momentum.where("score IS NOT NULL").join(F.broadcast(ends), "date", "left_semi").select("date", "entity", "score")


@stored("labels")
def labels(spark: SparkSession, root: str) -> DataFrame:
    return weekly_labels(bars(spark, root), weeks(spark, root))


@stored("scored_returns")
def scored_returns(spark: SparkSession, root: str) -> DataFrame:
    """``date, entity, score, ret`` for scored names that have a label."""
    ret = labels(spark, root).withColumnsRenamed({"sample_date": "date", "next_week_return": "ret"})
    return scores(spark, root).join(ret, ["date", "entity"])


PICK = Selection(top_pct=0.4, max_n=7, min_n=3, rebalance_every=2)
COSTS = Costs()


def picked(spark: SparkSession, root: str, cfg: Selection = PICK) -> DataFrame:
    return select_names(scores(spark, root), cfg)


@stored("positions")
def positions(spark: SparkSession, root: str) -> DataFrame:
    """Daily positions from momentum scores, rebalanced every other week."""
    scored = scores(spark, root)
    chosen = select_names(scored, PICK)
    plan = rebalance_plan(scored, chosen, PICK.rebalance_every)
    return daily_positions(chosen, plan, scored, calendar(spark, root))


@stored("moves")
def moves(spark: SparkSession, root: str) -> DataFrame:
    return M.transitions(positions(spark, root), bars(spark, root))


def stock_returns(spark: SparkSession, root: str) -> DataFrame:
    return M.stock_returns(moves(spark, root), COSTS)


@stored("nav")
def nav(spark: SparkSession, root: str) -> DataFrame:
    return M.daily_nav(stock_returns(spark, root))


def trades(spark: SparkSession, root: str) -> DataFrame:
    return M.trade_log(moves(spark, root), COSTS)


def index_returns(spark: SparkSession, root: str) -> DataFrame:
    """Daily returns of the three index series, keyed by ``series_id``."""
    return indices(spark, root).where("prev_close IS NOT NULL").select(
        F.col("entity").alias("series_id"), "date", (F.col("close") / F.col("prev_close") - 1).alias("ret")
    )


def industry_ids(spark: SparkSession, root: str) -> DataFrame:
    groups = B.brand_groups(spark, root).withColumnRenamed("sector", "name")
    return dimension_ids(groups).select("entity", "id")


def market_caps(spark: SparkSession, root: str) -> DataFrame:
    """Turnover of the last twenty bars, standing in for market cap."""
    return bars(spark, root).select(
        "entity", "date", F.round(R.rolling_sum("total_turnover", 20), 4).alias("market_cap")
    )


@stored("factor_windows")
def factor_windows(spark: SparkSession, root: str) -> DataFrame:
    """Fifty-row windows of all factors at every week end, one array per factor, as computed."""
    panel = bars(spark, root)
    return store.packed_windows(technical_factors(store.by_entity(panel, panel.count())), weeks(spark, root), FACTOR_COLUMNS)


def feature_store(spark: SparkSession, root: str) -> DataFrame:
    """The windows zero-filled and clipped, stored by sample date."""
    key = (spark.sparkContext.applicationId, root, "feature_store")
    path = scratch(spark, root, "feature_store")
    if key not in _WRITTEN:
        store.write_store(store.clip_packed(factor_windows(spark, root), FACTOR_COLUMNS), path)
        _WRITTEN[key] = path
    return store.read_store(spark, path, FACTOR_COLUMNS)


def sector_map(spark: SparkSession, root: str) -> DataFrame:
    return B.brand_groups(spark, root)


SECTORS = ["S0", "S1", "S2", "S3", "S4"]
INDICES = ["A", "N", "R"]


@stored("sector_day")
def sector_day(spark: SparkSession, root: str) -> DataFrame:
    return sector_bars(bars(spark, root), sector_map(spark, root), SECTORS)


def sector_series(spark: SparkSession, root: str) -> DataFrame:
    return sector_day(spark, root).withColumnRenamed("sector", "entity")


@stored("context")
def context(spark: SparkSession, root: str) -> DataFrame:
    return context_features(
        indices(spark, root), sector_series(spark, root), weeks(spark, root), INDICES, SECTORS
    )


@stored("candidates")
def candidates(spark: SparkSession, root: str) -> DataFrame:
    """Names that traded in a week, at its week end."""
    week = F.date_trunc("week", "date").cast("date")
    ends = weeks(spark, root).select(week.alias("week"), F.col("date").alias("end"))
    traded = bars(spark, root).select("entity", week.alias("week")).distinct()
    return traded.join(F.broadcast(ends), "week").select(F.col("end").alias("date"), "entity")


def suspended_flags(spark: SparkSession, root: str) -> DataFrame:
    """1 where a candidate has no bar on the day."""
    seen = bars(spark, root).select("date", "entity", F.lit(0).alias("_bar"))
    return candidates(spark, root).join(seen, ["date", "entity"], "left").select(
        "date", "entity", F.when(F.col("_bar").isNull(), 1).otherwise(0).alias("flag")
    )


def st_flags(spark: SparkSession, root: str) -> DataFrame:
    """1 for brands whose number divides by nine."""
    number = F.split("entity", "#")[1].cast("int")
    return candidates(spark, root).select("date", "entity", F.when(number % 9 == 0, 1).otherwise(0).alias("flag"))


UNIVERSE = UniverseRules(min_daily_turnover=3000.0)


@stored("flagged")
def flagged(spark: SparkSession, root: str) -> DataFrame:
    panel = bars(spark, root)
    return rule_columns(
        candidates(spark, root), panel, B.master(panel), suspended_flags(spark, root), st_flags(spark, root), UNIVERSE
    )
