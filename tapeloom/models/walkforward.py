"""Scores of walk-forward models: registry, choice among candidates, a model store and scoring as of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import Selection, UniverseRules
from tapeloom.operators import store
from tapeloom.operators.evaluation import rank_ic_ordinal
from tapeloom.operators.factors import technical_factors
from tapeloom.operators.pairwise import pairwise_loss
from tapeloom.operators.samples import model_rows
from tapeloom.operators.selection import industry_neutral, select_names
from tapeloom.operators.universe import rule_columns, tradable
from tapeloom.session import cut_lineage

LABEL = "next_week_return"


def clip_scores(scored: DataFrame, start, end) -> DataFrame:
    """Scores inside the backtest range."""
    day = F.col("date")
    return scored.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))


def registry(validated: DataFrame, beta: float = 1.0, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """One row per model (``by``): validation rank correlation and loss weighted by names, and their score.

    Higher is better: ``rank_ic - beta * loss``.
    """
    keys = [*by, "date"]
    per_date = rank_ic_ordinal(validated, by=keys).join(pairwise_loss(validated, by=keys, alpha=0.02), keys, "left")
    weight = F.sum("n")
    return per_date.groupBy(*by).agg(
        (F.sum(F.col("rank_ic") * F.col("n")) / weight).alias("val_avg_rankic"),
        (F.sum(F.coalesce("loss", F.lit(0.0)) * F.col("n")) / weight).alias("val_avg_pairwise_margin_loss"),
        F.count(F.lit(1)).alias("n_dates"),
    ).withColumn("val_score", F.col("val_avg_rankic") - beta * F.col("val_avg_pairwise_margin_loss"))


def staged_registry(staged: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row per window: the round with the best validation score (``best_epoch``, ties to the earlier), its numbers, and ``epoch_count``.

    ``staged`` holds validation scores after every round; all rounds are judged by the same jobs.
    """
    rounds = registry(staged, beta, ["window_id", "round"])
    best = F.max_by(F.struct("round", "val_avg_rankic", "val_avg_pairwise_margin_loss", "n_dates", "val_score"), F.struct(F.col("val_score"), -F.col("round"))).alias("b")
    return rounds.groupBy("window_id").agg(best, F.max("round").alias("epoch_count")).select(
        "window_id", "b.val_avg_rankic", "b.val_avg_pairwise_margin_loss", "b.n_dates", "b.val_score", F.col("b.round").alias("best_epoch"), "epoch_count")


def best_of(candidates: DataFrame, by: str = "window_id", name: str = "candidate") -> DataFrame:
    """The candidate with the highest validation score per window, ties by name."""
    best = candidates.groupBy(by).agg(F.max_by(F.struct(name, "val_score"), F.struct("val_score", name)).alias("b"))
    return best.select(by, "b.*")


def save_models(models: DataFrame, plan: DataFrame, path: str) -> None:
    """Linear models with ``trained_to``, the last day each was trained on; one row per window and penalty."""
    ends = plan.where("role = 'train'").groupBy("window_id").agg(F.max("date").alias("trained_to"))
    models.join(F.broadcast(ends), "window_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trained_to").parquet(path)


def model_as_of(spark: SparkSession, path: str, day) -> DataFrame:
    """The stored models of the last day at or before ``day``, or of the earliest day if none is; only that day is read."""
    index = spark.read.parquet(path).select(F.col("trained_to").cast("date").alias("trained_to"))
    at = F.lit(day).cast("date")
    found = index.agg(F.coalesce(F.max(F.when(F.col("trained_to") <= at, F.col("trained_to"))), F.min("trained_to")).alias("t")).first()["t"]
    models = spark.read.parquet(path).withColumn("trained_to", F.col("trained_to").cast("date"))
    return models.where(F.col("trained_to") == F.lit(found))


def rows_as_of(bars: DataFrame, day, columns: Sequence[str], master: DataFrame | None = None, suspended: DataFrame | None = None,
               st: DataFrame | None = None, rules: UniverseRules = UniverseRules(), context: DataFrame | None = None) -> DataFrame:
    """Model rows of the names that are tradable on the last market day at or before ``day``, from bars up to it.

    Windows, clipping and summaries are those of the feature store, with that day in place of a week end.
    """
    spark = bars.sparkSession
    past = bars.where(F.col("date") <= F.lit(day).cast("date"))
    at, n = past.agg(F.max("date"), F.count(F.lit(1))).first()
    if at is None:
        raise ValueError(f"no market day at or before {day}")
    end = spark.range(1).select(F.col("id").alias("week_ord"), F.lit(at).alias("date"))
    seen = past.where(F.col("date") == F.lit(at)).select("date", "entity").distinct()
    universe = tradable(rule_columns(seen, past, master, suspended, st, rules))
    packed = store.packed_windows(technical_factors(store.by_entity(past, n)), end, columns)
    # One row per name; read several times below.
    inside = cut_lineage(packed.join(universe.select(F.col("date").alias("sample_date"), "entity"), store.KEYS, "left_semi"))
    features = store.summarised(store.clip_packed(inside, columns), columns)
    labels = features.select(*store.KEYS, F.lit(None).cast("double").alias(LABEL))
    return model_rows(features, labels, context=context)


def score_as_of(rows: DataFrame, models: DataFrame, industry_ids: DataFrame, cfg: Selection) -> DataFrame:
    """``date, entity, weight, score, score_neutral, trained_to``: scores, industry-neutral scores and target weights of one day.

    Names are selected by the neutral score; names outside the selection get weight 0. ``models`` has one row.
    """
    total = F.aggregate(F.zip_with("features", "coefficients", lambda x, w: x * w), F.lit(0.0), lambda a, p: a + p)
    model = F.broadcast(models.select("coefficients", "intercept", "trained_to"))
    scored = rows.join(model, F.lit(True)).select(F.col("sample_date").alias("date"), "entity", (total + F.col("intercept")).alias("score"), "trained_to")
    neutral = industry_neutral(scored, industry_ids)
    chosen = select_names(neutral, cfg, "score_neutral").select("date", "entity", "weight")
    return neutral.join(chosen, ["date", "entity"], "left").select(
        "date", "entity", F.coalesce("weight", F.lit(0.0)).alias("weight"), "score", "score_neutral", "trained_to")

