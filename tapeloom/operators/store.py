"""The feature store: windows of all factors, one array per factor and sample, clipped across the entities of a date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.fixed_values import SCALE_EPS
from tapeloom.operators.labels import next_week_ord
from tapeloom.operators.samples import WINDOW
from tapeloom.session import cut_lineage

KEYS = ["sample_date", "entity"]
# Entities of a date that one task clips, values of a cell that are ordered together, and bins a range of keys is cut into.
PART, GATHER, BINS = 1024, 256, 64
# Bars whose factors one task computes.
DEALT = 4096
STATISTICS = ("last", "mean", "std", "d1", "d5", "d10", "m5", "m10", "m20")


def by_entity(bars: DataFrame, rows: int) -> DataFrame:
    """Bars dealt by entity, about ``DEALT`` of the ``rows`` to a task.

    All factors of a bar cost far more than its bytes, by which Spark merges partitions: 25 names of 1,785 days would meet
    in one or two tasks. A task has costs of its own too, so there are not as many as shuffles have.
    """
    return bars.repartition(max(1, -(-rows // DEALT)), "entity")


def packed_windows(panel: DataFrame, weeks: DataFrame, columns: Sequence[str], length: int = WINDOW) -> DataFrame:
    """``sample_date, entity`` and one array per column: the last ``length`` rows of each entity at each week end, oldest first.

    A row closes the windows of all week ends from its own date up to the entity's next row; only windows that are closed
    are cut out, one entity at a time. One shuffle by entity, the one that the factors already took. Entities with fewer
    rows, and windows without a single value, have no sample.
    """
    first_at = next_week_ord(panel.select("date").distinct(), weeks)
    last = weeks.agg(F.max("week_ord").alias("_last"))
    rows = panel.select("entity", "date", *columns).join(F.broadcast(first_at.toDF("date", "_from")), "date")
    rows = rows.join(F.broadcast(last), F.lit(True)).where("_from <= _last")
    kinds = {c: panel.schema[c].dataType.simpleString() for c in ("entity", *columns)}

    def closed(group: pa.Table) -> pa.Table:
        group = group.sort_by("date").combine_chunks()
        opens = group.column("_from").to_numpy().astype(np.int64)
        until = np.append(opens[1:], group.column("_last")[0].as_py() + 1) - 1
        alive = np.zeros(len(opens) + 1, np.int64)
        for c in columns:
            alive[1:] |= group.column(c).is_valid().to_numpy()
        alive = alive.cumsum()
        ends = np.flatnonzero((opens <= until) & (np.arange(len(opens)) >= length - 1))
        ends = ends[alive[ends + 1] > alive[ends + 1 - length]]
        places = pa.array((ends[:, None] + np.arange(1 - length, 1)).ravel())
        offsets = pa.array(np.arange(0, len(ends) * length + 1, length, dtype=np.int32))
        cut = [pa.ListArray.from_arrays(offsets, group.column(c).take(places).combine_chunks()) for c in columns]
        return pa.table([group.column("entity").take(pa.array(ends)), pa.array(opens[ends]), pa.array(until[ends]), *cut], ["entity", "_from", "_to", *columns])

    arrays = ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)
    spans = rows.groupBy("entity").applyInArrow(closed, f"entity {kinds['entity']}, _from long, _to long, {arrays}")
    at_week = spans.withColumn("week_ord", F.explode(F.sequence("_from", "_to"))).join(
        F.broadcast(weeks.select("week_ord", F.col("date").alias("sample_date"))), "week_ord")
    return at_week.select("sample_date", "entity", *columns)


def write_store(packed: DataFrame, path: str) -> None:
    """Puts the samples of each date in place of what the store holds for it; other dates stay."""
    packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_date").parquet(path)


def read_store(spark: SparkSession, path: str, columns: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Samples of the dates from ``start`` to ``end``; only these partitions and ``columns`` are read."""
    store = spark.read.parquet(path).withColumn("sample_date", F.col("sample_date").cast("date"))
    if start is not None:
        store = store.where(F.col("sample_date") >= F.lit(start).cast("date"))
    if end is not None:
        store = store.where(F.col("sample_date") <= F.lit(end).cast("date"))
    return store.select(*KEYS, *(columns or [c for c in store.columns if c not in KEYS]))


def store_digest(packed: DataFrame, columns: Sequence[str], length: int = WINDOW) -> DataFrame:
    """Per date and factor: cells, values, their sum, the sum weighted by place, the least and the greatest."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("v")) for c in columns])).alias("c")
    rows = packed.select("sample_date", cells).select("sample_date", "c.factor", F.col("c.v").alias("v"))
    zero = F.lit(0.0)
    per = rows.select(
        "sample_date", "factor", F.size("v").alias("n"), F.size(F.filter("v", lambda x: x.isNotNull())).alias("m"),
        F.aggregate("v", zero, lambda a, x: a + F.coalesce(x, zero)).alias("s"),
        F.aggregate(F.transform("v", lambda x, i: F.coalesce(x, zero) * (i + 1)), zero, lambda a, x: a + x).alias("ws"),
        F.array_min(F.filter("v", lambda x: x.isNotNull())).alias("lo"), F.array_max(F.filter("v", lambda x: x.isNotNull())).alias("hi"))
    return per.groupBy("sample_date", "factor").agg(
        F.sum("n").alias("n_cells"), F.sum("m").alias("n_values"), F.sum("s").alias("total"), F.sum("ws").alias("weighted"),
        F.min("lo").alias("low"), F.max("hi").alias("high"))


def packed_scaler(packed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``factor, mean, std``: over all samples and places, population deviation plus the guard, missing values left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.filter(c, lambda x: x.isNotNull()).alias("v")) for c in columns])).alias("c")

    def total(f):
        return F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))

    own = packed.select(cells).select("c.factor", F.col("c.v").alias("v")).where(F.size("v") > 0).withColumn("m", total(lambda x: x) / F.size("v"))
    per = own.select("factor", F.size("v").alias("n"), "m", F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))).alias("q"))
    # Spread within arrays plus spread of their means.
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    whole = per.groupBy("factor").agg(mean.alias("mean"), n.alias("n"), F.sum("q").alias("q"), F.collect_list(F.lit(None).cast("int")).alias("_none")).drop("_none")
    between = per.join(F.broadcast(whole.select("factor", F.col("mean").alias("_mean"))), "factor").groupBy("factor").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2)).alias("b"))
    return whole.join(between, "factor").select("factor", "mean", (F.sqrt((F.col("q") + F.col("b")) / F.col("n")) + SCALE_EPS).alias("std"))


def truncate_packed(packed: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """The newest ``length`` places of every window."""
    return packed.select(*KEYS, *[F.slice(c, F.greatest(F.size(c) - length, F.lit(0)) + 1, F.lit(length)).alias(c) for c in columns])


def summary_names(columns: Sequence[str]) -> list[str]:
    return [f"{c}_{k}" for c in columns for k in STATISTICS]


def summarised(packed: DataFrame, columns: Sequence[str], bound: float = 1e6) -> DataFrame:
    """``sample_date, entity, features``: nine numbers per column in the order of :func:`summary_names`.

    Last value, mean, population deviation, three changes and three recent means of the window, values clamped to
    ``bound``; missing and non-finite values are 0.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.clip(np.nan_to_num(_cells(batch, columns), nan=0.0, posinf=0.0, neginf=0.0), -bound, bound)
            last = cells[..., -1]
            parts = [last, cells.mean(axis=2), cells.std(axis=2), *(last - cells[..., -1 - k] for k in (1, 5, 10)),
                     *(cells[..., -k:].mean(axis=2) for k in (5, 10, 20))]
            flat = np.stack(parts, axis=2).reshape(batch.num_rows, -1)
            features = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("sample_date"), batch.column("entity"), features], [*KEYS, "features"])

    return packed.select(*KEYS, *columns).mapInArrow(work, "sample_date date, entity string, features array<double>")


def _cells(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """``rows x columns x length`` of a batch of packed windows; missing values are NaN."""
    n = batch.num_rows
    return np.stack([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in columns], axis=1)


# ---------------------------------------------------------------- clipping


def _matrix(group: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """``rows x (columns * length)``, missing values 0."""
    stacked = np.concatenate([np.stack(group[c].to_numpy()).astype(float) for c in columns], axis=1)
    return np.where(np.isfinite(stacked), stacked, 0.0)


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values."""
    raw = np.ascontiguousarray(values + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def _clamped(cells: np.ndarray, middle: np.ndarray, spread: np.ndarray, k: float) -> np.ndarray:
    reach = k * (spread + SCALE_EPS)
    return np.clip(cells, middle - reach, middle + reach)


def _shaped(group: pd.DataFrame, cells: np.ndarray, columns: Sequence[str]) -> pd.DataFrame:
    out = group[KEYS].copy()
    length = cells.shape[1] // len(columns)
    for i, c in enumerate(columns):
        out[c] = list(cells[:, i * length: (i + 1) * length])
    return out


def clip_packed(packed: DataFrame, columns: Sequence[str], k: float = 3.0, part: int = PART, gather: int = GATHER) -> DataFrame:
    """Clamps every cell (factor and place) to median +/- ``k`` median absolute deviations across the entities of its date.

    Missing values are 0 first. A date of up to ``part`` entities is one group. A larger one is cut by hash into groups
    of about that size, which never meet: their medians are found by :func:`cell_medians`, for all cells together, and
    each group is then clamped by them. Results do not depend on ``part``.
    """
    sizes = packed.groupBy("sample_date").agg(F.count(F.lit(1)).alias("_n"))
    sized = packed.join(F.broadcast(sizes), "sample_date")  # one row per week of the calendar
    schema = packed.select(*KEYS, *columns).schema

    def whole(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        cells = _cells(batch, columns)
        cells = np.where(np.isfinite(cells), cells, 0.0)
        middle = np.median(cells, axis=0)
        cells = _clamped(cells, middle, np.median(np.abs(cells - middle), axis=0), k)
        offsets = pa.array(np.arange(0, len(cells) * cells.shape[2] + 1, cells.shape[2], dtype=np.int32))
        clipped = [pa.ListArray.from_arrays(offsets, pa.array(cells[:, i].ravel())) for i in range(len(columns))]
        return pa.table([*(batch.column(c) for c in KEYS), *clipped], [*KEYS, *columns])

    small = sized.where(F.col("_n") <= part).select(*KEYS, *columns).groupBy("sample_date").applyInArrow(whole, schema)
    if sizes.where(F.col("_n") > part).isEmpty():
        return small
    cut = F.pmod(F.xxhash64("entity"), F.ceil(F.col("_n") / part)).alias("part")
    large = cut_lineage(sized.where(F.col("_n") > part).select(*KEYS, *columns, cut))
    middle = cut_lineage(cell_medians(large, columns, None, gather))
    spread = cell_medians(large, columns, middle, gather).withColumnRenamed("median", "spread")
    bounds = middle.withColumnRenamed("median", "middle").join(spread, "sample_date")

    def clamp(rows: pd.DataFrame, bound: pd.DataFrame) -> pd.DataFrame:
        cells = _matrix(rows, columns)
        return _shaped(rows, _clamped(cells, *(np.frombuffer(bound[c].iloc[0]) for c in ("middle", "spread")), k), columns)

    return small.unionByName(_cogrouped(large, bounds, clamp, schema))


def _cogrouped(large: DataFrame, state: DataFrame, fn, schema) -> DataFrame:
    """``fn(rows of one part of a date, the date's state)``; the state is copied once per part."""
    parts = large.select(F.col("sample_date").alias("_d"), F.col("part").alias("_p")).distinct()
    copies = state.join(parts, F.col("sample_date") == F.col("_d")).drop("sample_date")
    return large.groupBy("sample_date", "part").cogroup(copies.groupBy("_d", "_p")).applyInPandas(fn, schema)


def cell_medians(large: DataFrame, columns: Sequence[str], centre: DataFrame | None, gather: int = GATHER) -> DataFrame:
    """``sample_date, median``: packed medians of every cell of ``large`` (rows with ``part``), of ``|x - centre|`` if given.

    All cells of a date are searched together. Values become order-preserving 64-bit keys; every cell keeps a range of
    keys that holds its two middle ranks and the number of keys below it. A pass counts the keys of each range in
    ``BINS`` bins per part and adds the counts as vectors, which keeps the bins of the middle ranks; each pass shrinks
    the ranges by ``BINS``, so there are at most eleven. Once no range holds more than ``gather`` values, these are
    brought together and ordered. What meets in one group depends on the number of cells, not of entities.
    """
    empty = large.sparkSession.createDataFrame([], "sample_date date, median binary")
    centre = large.select("sample_date").distinct().join(centre if centre is not None else empty, "sample_date", "left").withColumnRenamed("median", "centre")

    def keys(rows: pd.DataFrame, state: pd.DataFrame) -> np.ndarray:
        cells = _matrix(rows, columns)
        own = state["centre"].iloc[0]
        return _keys(cells if own is None else np.abs(cells - np.frombuffer(own)))

    def extremes(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own = keys(rows, state)
        return pd.DataFrame({"sample_date": [rows["sample_date"].iloc[0]], "n": [len(own)], "low": [own.min(axis=0).tobytes()], "high": [own.max(axis=0).tobytes()]})

    def widest(parts: pd.DataFrame) -> pd.DataFrame:
        low = np.min([np.frombuffer(b, np.uint64) for b in parts["low"]], axis=0)
        high = np.max([np.frombuffer(b, np.uint64) for b in parts["high"]], axis=0)
        n = int(parts["n"].sum())
        ranks = np.repeat([(n - 1) // 2, n // 2], len(low))
        return pd.DataFrame({"sample_date": [parts["sample_date"].iloc[0]], "low": [np.tile(low, 2).tobytes()], "high": [np.tile(high, 2).tobytes()],
                             "rank": [ranks.tobytes()], "most": [n]})

    ends = _cogrouped(large, centre, extremes, "sample_date date, n long, low binary, high binary")
    kind = "sample_date date, low binary, high binary, rank binary, most long"
    state = ends.groupBy("sample_date").applyInPandas(widest, kind)
    state = cut_lineage(state.join(centre, "sample_date"))

    def counted(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own = np.tile(keys(rows, state), 2)
        low, high = (np.frombuffer(state[c].iloc[0], np.uint64) for c in ("low", "high"))
        width = (high - low) // np.uint64(BINS) + np.uint64(1)
        inside = (own >= low) & (own <= high)
        bins = ((own - low) // width).astype(np.int64)
        place = np.arange(own.shape[1]) * BINS + bins
        counts = np.bincount(place[inside], minlength=own.shape[1] * BINS).astype(float)
        return pd.DataFrame({"sample_date": [rows["sample_date"].iloc[0]], "counts": [counts]})

    def narrowed(both: pd.DataFrame) -> pd.DataFrame:
        row = both.iloc[0]
        low, high = (np.frombuffer(row[c], np.uint64) for c in ("low", "high"))
        rank, counts = np.frombuffer(row["rank"], np.int64), np.rint(row["counts"]).astype(np.int64).reshape(len(low), BINS)
        width = (high - low) // np.uint64(BINS) + np.uint64(1)
        upto = counts.cumsum(axis=1)
        chosen = (upto <= rank[:, None]).sum(axis=1)
        at = np.arange(len(low))
        rank = rank - np.where(chosen > 0, upto[at, np.maximum(chosen - 1, 0)], 0)
        low = low + chosen.astype(np.uint64) * width
        high = np.minimum(high, low + (width - np.uint64(1)))
        done = low == high
        return pd.DataFrame({"sample_date": [row["sample_date"]], "low": [low.tobytes()], "high": [high.tobytes()], "rank": [rank.tobytes()],
                             "most": [int(np.where(done, 0, counts[at, chosen]).max())]})

    while (state.agg(F.max("most")).first()[0] or 0) > gather:
        counts = _cogrouped(large, state, counted, "sample_date date, counts array<double>").select("sample_date", array_to_vector("counts").alias("c"))
        sums = counts.groupBy("sample_date").agg(vector_to_array(Summarizer.sum(F.col("c"))).alias("counts"))
        state = cut_lineage(state.join(sums, "sample_date").groupBy("sample_date").applyInPandas(narrowed, kind).join(centre, "sample_date"))

    def inside(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own = np.tile(keys(rows, state), 2)
        low, high = (np.frombuffer(state[c].iloc[0], np.uint64) for c in ("low", "high"))
        cell, row = np.nonzero(((own >= low) & (own <= high) & (low < high)).T)
        return pd.DataFrame({"sample_date": [rows["sample_date"].iloc[0]], "cells": [cell.astype(np.int32).tobytes()], "keys": [own.T[cell, row].tobytes()]})

    def settled(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        keys_, rank = np.frombuffer(row["low"], np.uint64).copy(), np.frombuffer(row["rank"], np.int64)
        cell = np.concatenate([np.frombuffer(b, np.int32) for b in found["cells"]])
        own = np.concatenate([np.frombuffer(b, np.uint64) for b in found["keys"]])
        order = np.lexsort((own, cell))
        cell, own = cell[order], own[order]
        cells = np.unique(cell)
        keys_[cells] = own[np.searchsorted(cell, cells) + rank[cells]]
        lower, upper = _values(keys_).reshape(2, -1)
        return pd.DataFrame({"sample_date": [row["sample_date"]], "median": [((lower + upper) / 2).tobytes()]})

    found = _cogrouped(large, state, inside, "sample_date date, cells binary, keys binary").withColumnRenamed("sample_date", "_f")
    return state.groupBy("sample_date").cogroup(found.groupBy("_f")).applyInPandas(settled, "sample_date date, median binary")
