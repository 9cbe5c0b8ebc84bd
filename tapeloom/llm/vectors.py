"""Vector tables: which rows take part, packing into blocks, and the merging of partial hit lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str, allow_zero: bool = True) -> DataFrame:
    """``id, v`` (array<double>) of the rows that can take part.

    Left out: null ids, null vectors, null or non-finite components, with ``allow_zero=False`` zero vectors, and
    vectors of another length than most have (ties: the shorter). Rows that repeat an id count once, as the least vector.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not allow_zero:
        sound = sound & F.exists(v, lambda x: x != 0.0)
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, 0))


def unpack(blob: bytes, columns: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, columns)


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct hits of each query, ties to the smaller id: ``query_id, rank, vec_id, score``."""
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to smaller ids, best first."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def is_query(every: int, key: str = "id") -> Column:
    return F.pmod(F.col(key), F.lit(every)) == 0
