"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import n_words, stored

# Units that one leaf of the tree settles, and residuals that one inner node combines.
LEAF, FAN = 4096, 64
SEED = 20_240
_UNIT = "id long, source string, size long, n long, source_size long, target double, copies long, p double, sid long, node long"
EDGE = 1e-9


def source_targets(units: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: ``source, sid, source_size, units, target``.

    Sources in code-point order, null last, take the ``weights`` in turn and share ``share`` times all sizes by them; a
    target stops at ``cap`` times its source's size and the excess is shared by weight among the others, until none is
    above. In closed form: with sources in order of ``cap * size / weight``, those before the first whose ratio reaches
    the level left for it are full, all others get weight times that level. The windows see one row per source.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    taking = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("sid", F.row_number().over(order).cast("long") - 1).withColumn(
        "w", F.element_at(taking, (F.pmod("sid", F.lit(len(weights))) + 1).cast("int")))
    ratio = ranked.withColumn("full", cap * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("w"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_ = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = ratio.withColumn("level", left / open_)
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level"))).over(everything)
    target = F.when(first.isNull(), F.col("full")).otherwise(F.least("full", F.col("w") * first["level"]))
    return level.select("source", "sid", "source_size", "units", target.alias("target"))


def _settle(group: pd.DataFrame, final: bool) -> pd.DataFrame:
    """Pair the open units of one node, largest first, until at most one has a fractional probability.

    Of a pair, mass (words) moves one way or the other, as far as makes one probability 0 or 1; the odds keep both
    expectations. The words of the node stay the same. ``final`` rounds the last open unit to the nearer end.
    """
    group = group.sort_values(["size", "id", "source"], ascending=False, kind="stable", na_position="last", ignore_index=True)
    mass = (group["size"] * group["n"]).to_numpy(float)
    p = group["p"].to_numpy(float).copy()
    key = SEED ^ (int(group["sid"].iloc[0]) * 1_000_003 + int(group["node"].iloc[0]) * 8191)
    chance = np.random.default_rng(abs(key) * 2 + int(final)).random(len(p))
    held = -1
    for j in range(len(p)):
        if not EDGE < p[j] < 1 - EDGE:
            p[j] = round(p[j])
        elif mass[j] == 0:
            p[j] = float(chance[j] < p[j])
        elif held < 0:
            held = j
        else:
            i = held
            up = min((1 - p[i]) * mass[i], p[j] * mass[j])
            down = min(p[i] * mass[i], (1 - p[j]) * mass[j])
            moved = up if chance[j] * (up + down) < down else -down
            p[i] += moved / mass[i]
            p[j] -= moved / mass[j]
            open_ = [k for k in (i, j) if EDGE < p[k] < 1 - EDGE]
            for k in (i, j):
                if k not in open_:
                    p[k] = round(p[k])
            # Both can stay open only by rounding errors; the smaller one is then settled where it nearly is.
            if len(open_) == 2:
                p[j] = round(p[j])
                open_ = [i]
            held = open_[0] if open_ else -1
    if final and held >= 0:
        p[held] = round(p[held])
    group["p"] = p
    return group


def mix_plan(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
             weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each unit: ``id, source, size, n, source_size, target, copies``.

    A unit is what ``n`` rows with equal key, source and size have in common; all of them get its ``copies``. Each
    unit should be taken ``target / source_size`` times: the whole part is sure, the fraction is a probability that
    pivotal rounding makes 0 or 1. Units fall by hash into leaves of about ``LEAF`` per source; a leaf leaves one open
    unit at most, ``FAN`` nodes' open units meet in the next node, and so on up to one node per source. So the words
    taken of a source differ from its target by at most half of the largest unit, no task holds a source, and reruns
    agree. Units without words are rounded on their own. A null size counts as 0; a null source is a source; an empty
    table gives an empty result.
    """
    amount = F.coalesce(size if size is not None else n_words("text"), F.lit(0)).cast("long")
    units = stored(docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), amount.alias("size"))
                   .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    aims = stored(source_targets(units, weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaves = F.ceil(F.col("units") / LEAF)
    joined = units.join(aims.withColumnRenamed("source", "_s").hint("shuffle_hash" if aims.count() > 100_000 else "broadcast"),
                        F.col("source").eqNullSafe(F.col("_s")))
    now = joined.select("id", "source", "size", "n", "source_size", "target", F.floor(rate).alias("copies"),
                        (rate - F.floor(rate)).alias("p"), "sid", F.pmod(F.xxhash64("id", "source", "size"), leaves).alias("node"))
    most = aims.agg(F.max(leaves)).first()[0] or 1
    settled = None
    is_open = (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
    while True:
        final = most == 1
        level = stored(now.groupBy("sid", "node").applyInPandas(lambda g: _settle(g, final), _UNIT), "mix-level")
        done = level.where(~is_open)
        settled = done if settled is None else settled.union(done)
        if final:
            break
        most = -(-most // FAN)
        now = level.where(is_open).withColumn("node", F.floor(F.col("node") / FAN))
    return settled.select("id", "source", "size", "n", "source_size", "target",
                          (F.col("copies") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as :func:`mix_plan` takes it, with its own columns only."""
    amount = F.coalesce(size if size is not None else n_words("text"), F.lit(0)).cast("long")
    plan = mix_plan(docs, key, source, size, weights, share, cap).where("copies > 0").select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    same = (F.col(key).cast("long").eqNullSafe(F.col("_id")) & F.col(source).cast("string").eqNullSafe(F.col("_source"))
            & (F.col("_amount") == F.col("_size")))
    joined = docs.withColumn("_amount", amount).join(plan.hint("shuffle_hash"), same)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
