"""Statistics across the entities of one group (usually one date).

A group can hold any share of the rows. Means and counts are aggregates joined
back; exact quantiles are bracketed by sketches and counted inside the bracket.
Ranks, positions, dense ids and neighbours come from one mechanism: rows are
cut into ranges of their order, as many as their number asks for, so a large
group spreads over many ranges and a range holds many small groups. Ranges are
numbered on their own and chained by their counts; results are the same for any
number of ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

# Rows of a range.
PIECE = 500_000
# Rank accuracy of the sketches behind exact quantiles, and how far from the wanted share their brackets reach.
ACCURACY, BRACKET = 2000, 0.002


def in_pieces(df: DataFrame, by: Sequence[str], order: Sequence[str], piece: int | None = None) -> DataFrame:
    """``df`` with ``_piece``: consecutive ranges of the order ``by, order``, stored.

    ``order`` should tell rows of a group apart; rows equal in all of it share a range.
    """
    ranges = max(1, -(-df.count() // (piece or PIECE)))
    return cut_lineage(df.repartitionByRange(ranges, *by, *order).withColumn("_piece", F.spark_partition_id()))


def chained(pieces: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows of :func:`in_pieces` with ``_before``: the weights of the rows before them in their group (without, their number)."""
    by = list(by)
    weight = F.lit(1) if weight is None else weight
    totals = pieces.groupBy(*by, "_piece").agg(F.sum(weight).alias("_in"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_piece", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return counted.join(starts, [*by, "_piece"]).withColumn("_before", F.col("_start") + F.col("_own")).drop("_start", "_own", "_piece")


def with_next(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], piece: int | None = None) -> DataFrame:
    """``df`` with ``<value>_2``: the values of the next row of the group, null for the last.

    Inside a range by a window; the last row of a range takes the first row of the group's next range.
    """
    by = list(by)
    cut = in_pieces(df, by, order, piece)
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    firsts = cut.groupBy(*by, "_piece").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    following = firsts.select(*by, "_piece", F.lead("_first").over(Window.partitionBy(*by).orderBy("_piece")).alias("_after"))
    own = cut.withColumn("_next", F.lead(F.struct(*values)).over(inside)).join(following, [*by, "_piece"])
    following_row = F.coalesce("_next", "_after")
    return own.withColumns({f"{v}_2": following_row[v] for v in values}).drop("_next", "_after", "_piece")


def attach(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Group aggregates as extra columns on every row of the group."""
    stats = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggregates.items()])
    return df.join(stats, list(by))


def mean_within(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return attach(df, by, {out: F.avg(value)})


def value_counts_before(df: DataFrame, by: Sequence[str], value: str, piece: int | None = None) -> DataFrame:
    """Per distinct value of a group: rows with it (``n``), rows below it (``below``), group ``total``."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = chained(in_pieces(counts, by, [value], piece), by, [value], F.col("n"))
    return placed.join(totals, by).select(*by, value, "n", F.col("_before").alias("below"), "total")


def _long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), "_name", "_value").where("_value IS NOT NULL")


def _wide_values(long: DataFrame, keys: Sequence[str], outs: Mapping[str, str]) -> DataFrame:
    picks = [F.max(F.when(F.col("_name") == c, F.col("_place"))).alias(out) for c, out in outs.items()]
    return long.groupBy(*keys).agg(*picks)


def ranks(df: DataFrame, by: Sequence[str], key: str, outs: Mapping[str, str], piece: int | None = None) -> DataFrame:
    """Ascending group ranks with averaged ties: one row per group and key, ``{column: rank name}``.

    All columns go through one long table, so they are ranked by the same jobs. Only distinct values are put in order.
    """
    group = [*by, "_name"]
    long = _long_values(df, [*by, key], list(outs))
    counted = value_counts_before(long, group, "_value", piece).select(*group, "_value", (F.col("below") + (F.col("n") + 1) / 2).alias("_place"))
    return _wide_values(long.join(counted, [*group, "_value"]), [*by, key], outs)


def positions_of(df: DataFrame, by: Sequence[str], key: str, outs: Mapping[str, str], piece: int | None = None) -> DataFrame:
    """Group positions 1..n without shared places; ties are ordered by the hash of ``key``."""
    group, order = [*by, "_name"], ["_value", "_hash", key]
    long = _long_values(df, [*by, key], list(outs)).withColumn("_hash", F.md5(F.col(key).cast("string")))
    placed = chained(in_pieces(long, group, order, piece), group, order)
    return _wide_values(placed.withColumn("_place", (F.col("_before") + 1).cast("double")), [*by, key], outs)


def with_quantiles(df: DataFrame, by: Sequence[str], value: str, outs: Mapping[str, float]) -> DataFrame:
    """Exact group quantiles (linear interpolation), one row per group with a value.

    Approximate quantiles a little below and above bracket each wanted place. One aggregation then counts the rows below
    the bracket and the distinct values inside it, and the exact value is read off their running counts. All steps
    combine map-side; what is left of a group to be ordered is the bracket, whatever the group's size.
    """
    by = list(by)
    present = df.select(*by, value).where(F.col(value).isNotNull())
    shares = [s for p in outs.values() for s in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    sketch = present.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
                                      F.percentile_approx(value, shares, ACCURACY).alias("_near"))
    few = F.col("_n") <= ACCURACY
    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(few, F.col("_min")).otherwise(F.col("_near")[2 * i]).alias("low"),
                 F.when(few, F.col("_max")).otherwise(F.col("_near")[2 * i + 1]).alias("high")) for i in range(len(outs))])
    bracketed = present.join(sketch.select(*by, "_n", brackets.alias("_b")), by)
    hit = F.explode(F.filter("_b", lambda b: F.col(value) <= b["high"])).alias("_h")
    counts = bracketed.select(*by, "_n", value, hit).select(
        *by, "_n", F.col("_h.i").alias("_i"), F.when(F.col(value) >= F.col("_h.low"), F.col(value)).alias("_v")).groupBy(
        *by, "_n", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    so_far = Window.partitionBy(*by, "_n", "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in outs.values()]), F.col("_i") + 1)
    run = counts.withColumn("_run", F.sum("_c").over(so_far)).withColumn("_h", place)
    picks = []
    for i, name in enumerate(outs):
        mine = F.col("_i") == i
        picks += [F.min(F.when(mine & (F.col("_run") > F.floor("_h")), F.col("_v"))).alias(f"_lo_{name}"),
                  F.min(F.when(mine & (F.col("_run") > F.ceil("_h")), F.col("_v"))).alias(f"_hi_{name}"),
                  F.max(F.when(mine, F.col("_h") - F.floor("_h"))).alias(f"_at_{name}")]
    found = run.groupBy(*by).agg(*picks)
    return found.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")).alias(n) for n in outs])


def medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact group medians of several columns, one row per group.

    All columns go through one long table ``(group, column name, value)``, so the number of jobs does not grow with the
    number of columns.
    """
    found = with_quantiles(_long_values(df, by, columns), [*by, "_name"], "_value", {"_q": 0.5})
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c) for c in columns])
    return df.select(*by).distinct().join(wide, list(by), "left")


def text_positions(df: DataFrame, name: str, out: str, piece: int | None = None) -> DataFrame:
    """Zero-based position of each distinct text in sorted order."""
    whole = df.select(name, F.lit(0).alias("_all"))
    return chained(in_pieces(whole, ["_all"], [name], piece), ["_all"], [name]).select(name, F.col("_before").cast("long").alias(out))


def best_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows per group in ``order``; Spark keeps ``n`` per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
