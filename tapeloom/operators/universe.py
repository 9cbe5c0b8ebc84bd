"""Tradability rules: one Boolean column per rule, their conjunction, and attrition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import UniverseRules
from tapeloom.functions.scalars import board, short_code
from tapeloom.operators.crosssection import best_n

RULES = ("board", "suspended", "st", "turnover", "missing_info", "ipo", "delisted", "limit")


def limit_like(rules: UniverseRules = UniverseRules()) -> Column:
    """Close to a limit move: large day return pinned to the extreme, or open and close both on it."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    move = F.when(o > 0, c / o - 1).otherwise(0.0)
    near = rules.limit_near

    def at(price: Column, level: Column) -> Column:
        return F.abs(price - level) <= near * F.greatest(F.lit(1.0), level)

    up = ((move >= rules.limit_move) & (c >= h * (1 - near))) | (at(o, h) & at(c, h))
    down = ((move <= -rules.limit_move) & (c <= l * (1 + near))) | (at(o, l) & at(c, l))
    complete = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    return F.when(complete, up | down).otherwise(False)


def _with_flag(df: DataFrame, flags: DataFrame, name: str, strict: bool) -> DataFrame:
    """Attach a flag by exact code, else by its shortened spelling; unknown is clear unless strict.

    A code that is listed more than once a day has its greatest flag.
    """
    known = flags.groupBy("date", "entity").agg(F.max("flag").alias(f"_{name}"))
    short = known.withColumnsRenamed({"entity": "_short", f"_{name}": f"_{name}2"})
    out = (
        df.withColumn("_short", short_code("entity"))
        .join(known, ["date", "entity"], "left")
        .join(short, ["date", "_short"], "left")
    )
    unknown = F.lit(1 if strict else 0)
    return out.withColumn(name, F.coalesce(f"_{name}", f"_{name}2", unknown) == 1).drop("_short", f"_{name}", f"_{name}2")


def rule_columns(
    candidates: DataFrame,
    bars: DataFrame | None,
    master: DataFrame | None = None,
    suspended: DataFrame | None = None,
    st: DataFrame | None = None,
    rules: UniverseRules = UniverseRules(),
) -> DataFrame:
    """``candidates(date, entity)`` with ``fails_<rule>`` per rule.

    A table that is not given switches its rule off; without a stock master
    missing information is allowed.
    """
    df = candidates.select("date", "entity")
    never = F.lit(False)
    fails: dict[str, Column] = {"board": board("entity").isin(*rules.excluded_boards) if rules.excluded_boards else never}
    if suspended is not None and rules.exclude_suspended:
        df = _with_flag(df, suspended, "fails_suspended", rules.strict_flags)
    else:
        fails["suspended"] = never
    if st is not None and rules.exclude_st:
        df = _with_flag(df, st, "fails_st", rules.strict_flags)
    else:
        fails["st"] = never
    if bars is not None:
        prices = bars.select("date", "entity", "open", "high", "low", "close", "total_turnover")
        df = df.join(prices, ["date", "entity"], "left")
        enough = F.coalesce(F.col("total_turnover") >= rules.min_daily_turnover, F.lit(False))
        fails["turnover"] = ~enough if rules.min_daily_turnover > 0 else never
        fails["limit"] = limit_like(rules)
    else:
        fails |= {"turnover": never, "limit": never}
    if master is not None:
        df = df.join(master.select("entity", "ipo_date", "delist_date"), "entity", "left")
        fails["missing_info"] = never if rules.allow_missing_info else F.col("ipo_date").isNull()
        fails["ipo"] = F.coalesce(F.datediff("date", "ipo_date") < rules.ipo_cut_days, never)
        fails["delisted"] = F.coalesce(F.col("date") >= F.col("delist_date"), never)
    else:
        fails |= {"missing_info": never, "ipo": never, "delisted": never}
    df = df.withColumns({f"fails_{r}": c for r, c in fails.items()})
    return df.select("date", "entity", *[f"fails_{r}" for r in RULES])


def tradable(flagged: DataFrame) -> DataFrame:
    """Candidates that fail no rule."""
    keep = F.lit(True)
    for r in RULES:
        keep = keep & ~F.col(f"fails_{r}")
    return flagged.where(keep).select("date", "entity")


def first_cause(flagged: DataFrame) -> DataFrame:
    """The first rule each candidate fails, in rule order; NULL if it passes."""
    cause = F
    for r in RULES:
        cause = cause.when(F.col(f"fails_{r}"), r)
    return flagged.withColumn("cause", cause.otherwise(F.lit(None).cast("string")))


def attrition(flagged: DataFrame) -> DataFrame:
    """Per date and rule: how many remain before it, how many it removes, how many are left.

    Each candidate is counted once, at the first rule it fails. The running
    total goes over the eight rules of a date.
    """
    counted = first_cause(flagged).groupBy("date").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("cause") == r).alias(r) for r in RULES]
    )
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.col(r).alias("removed")) for i, r in enumerate(RULES)])
    rows = counted.select("date", "total", F.explode(steps).alias("s")).select("date", "total", "s.*")
    gone = F.sum("removed").over(Window.partitionBy("date").orderBy("step"))
    return rows.select(
        "date", "rule", (F.col("total") - gone + F.col("removed")).alias("before"), "removed", (F.col("total") - gone).alias("after")
    )


def culprit(report: DataFrame) -> DataFrame:
    """For dates that end empty: the rule that removed the last candidates."""
    emptied = report.where("after = 0 AND removed > 0")
    return emptied.select("date", F.col("rule").alias("culprit"))


def samples(flagged: DataFrame, n: int = 10) -> DataFrame:
    """Up to ``n`` removed names per date and cause, alphabetically."""
    removed = first_cause(flagged).where("cause IS NOT NULL").select("date", "cause", "entity")
    few = best_n(removed, ["date", "cause"], [F.col("entity")], n)
    names = F.array_join(F.array_sort(F.collect_list("entity")), ",")
    return few.groupBy("date", "cause").agg(names.alias("names"))
