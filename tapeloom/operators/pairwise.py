"""Pairwise logistic ranking loss as an evaluation metric, on sampled pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.crosssection import with_next


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sampled_pairs(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], rounds: int = 4, piece: int | None = None) -> DataFrame:
    """Random pairs of rows of the same group: each round pairs every row with its hash neighbour.

    A round yields one pair per row, so the number of pairs grows with the group and not with its square. Rows are cut
    into ranges of the hash order, so no group outgrows a task and pairs are the same for any number of ranges.
    """
    dealt = df.select(*by, key, *values).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_round").cast("string")))
    )
    paired = with_next(dealt, [*by, "_round"], ["_h", key], values, piece)
    return paired.select(*by, *values, *[f"{v}_2" for v in values])


def pairwise_loss(
    df: DataFrame,
    pred: str = "score",
    target: str = "ret",
    by: Sequence[str] = ("date",),
    key: str = "entity",
    margin: float = 0.0,
    alpha: float | None = None,
    w_max: float = 3.0,
    rounds: int = 4,
) -> DataFrame:
    """Mean ``softplus(margin - sign(dy) * ds)`` over sampled pairs with different targets.

    With ``alpha`` a pair weighs ``min(|dy| / alpha, w_max)``.
    """
    pairs = sampled_pairs(df, by, key, [pred, target], rounds)
    dy = F.col(target) - F.col(f"{target}_2")
    ds = F.col(pred) - F.col(f"{pred}_2")
    loss = softplus(F.lit(margin) - F.signum(dy) * ds)
    if alpha:
        loss = F.least(F.abs(dy) / alpha, F.lit(w_max)) * loss
    return pairs.where(dy != 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(loss).alias("loss"))
