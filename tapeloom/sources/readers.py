"""Readers and writers for panels, calendars, flag matrices and the stock master."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.fixed_values import (
    CODE_NAMES,
    DELIST_NAMES,
    IPO_NAMES,
    MAP_KEY_NAMES,
    MAP_VALUE_NAMES,
    NEVER_DELISTED_AFTER,
    TEXT_ENCODINGS,
)
from tapeloom.functions.scalars import finite, flag_value, parse_date_flexible

PANEL_VALUES = ("open", "high", "low", "close", "volume", "total_turnover", "num_trades")


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet dataset, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "utf-8") -> DataFrame | None:
    """A delimited dataset with a header in one of the known encodings, or None if absent.

    Regional encodings need ``spark.sql.legacy.javaCharsets`` to be set in the session.
    """
    if encoding not in TEXT_ENCODINGS:
        raise ValueError(f"encoding must be one of {TEXT_ENCODINGS}")
    if encoding not in ("utf-8", "latin-1") and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError(f"set spark.sql.legacy.javaCharsets to read {encoding}")
    charset = "iso-8859-1" if encoding == "latin-1" else encoding
    reader = spark.read.option("header", True).option("encoding", charset)
    if schema:
        reader = reader.schema(schema)
    try:
        return reader.csv(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet at ``path``, else the delimited twin beside it."""
    found = read_parquet(spark, path) if path.endswith(".parquet") else None
    if found is None:
        found = read_csv(spark, path.removesuffix(".parquet").removesuffix(".csv") + ".csv")
    if found is None:
        raise FileNotFoundError(path)
    return found


def write(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def pick(df: DataFrame, names: Iterable[str], required: bool = True) -> Column | None:
    """The first column whose trimmed lower-case header is among ``names``."""
    headers = {c.strip().lower(): c for c in df.columns}
    for name in names:
        if name in headers:
            return F.col(f"`{headers[name]}`")
    if required:
        raise ValueError(f"none of {tuple(names)} in {df.columns}")
    return None


def normalise_panel(df: DataFrame, values: Sequence[str] = PANEL_VALUES, required: Sequence[str] = ("close",)) -> DataFrame:
    """Canonical panel: ``entity``, ``date`` and double columns with no NaN or infinity."""
    entity = pick(df, ("entity", "order_book_id", "stock", "code", "sector"))
    day = pick(df, ("date", "datetime", "trading_day"))
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"panel lacks {lacking}")
    present = [c for c in values if c in df.columns]
    return df.select(
        F.trim(entity.cast("string")).alias("entity"),
        day.cast("date").alias("date"),
        *[finite(F.col(c).cast("double")).alias(c) for c in present],
    )


def read_calendar(df: DataFrame) -> DataFrame:
    """Distinct trading days from a named column, or from the first one."""
    day = pick(df, ("trading_day", "date"), required=False)
    day = F.col(f"`{df.columns[0]}`") if day is None else day
    parsed = parse_date_flexible(day.cast("string"))
    return df.select(parsed.alias("date")).where("date IS NOT NULL").distinct()


def read_master(df: DataFrame) -> DataFrame:
    """Stock master as ``entity, ipo_date, delist_date``; rows without a listing date are dropped."""
    delist = pick(df, DELIST_NAMES, required=False)
    gone = F.lit(None).cast("date") if delist is None else parse_date_flexible(delist.cast("string"))
    return df.select(
        F.trim(pick(df, CODE_NAMES).cast("string")).alias("entity"),
        parse_date_flexible(pick(df, IPO_NAMES).cast("string")).alias("ipo_date"),
        F.when(gone <= F.lit(NEVER_DELISTED_AFTER).cast("date"), gone).alias("delist_date"),
    ).where("ipo_date IS NOT NULL")


def read_flags(wide: DataFrame, date_col: str | None = None) -> DataFrame:
    """Unpivot a date-by-code flag matrix to ``date, entity, flag`` with flag 0 or 1."""
    date_col = date_col or wide.columns[0]
    codes = [c for c in wide.columns if c != date_col]
    text = wide.select(
        parse_date_flexible(F.col(f"`{date_col}`").cast("string")).alias("date"),
        *[F.col(f"`{c}`").cast("string").alias(c) for c in codes],
    )
    long = text.unpivot(["date"], [f"`{c}`" for c in codes], "entity", "raw")
    return long.select("date", "entity", flag_value("raw").alias("flag"))


def classification_map(df: DataFrame, value: str, name: str) -> DataFrame:
    """Code and one classification level out of a vendor classification table."""
    return df.select(F.trim(pick(df, MAP_KEY_NAMES).cast("string")).alias("entity"), F.trim(F.col(value)).alias(name))


def read_map(df: DataFrame) -> DataFrame:
    return df.select(
        pick(df, MAP_KEY_NAMES).cast("string").alias("entity"),
        pick(df, MAP_VALUE_NAMES).cast("string").alias("name"),
    )


def read_positions(df: DataFrame, start=None, end=None) -> DataFrame:
    """Positions with numeric weights inside a date range; missing and zero weights are dropped."""
    lacking = {"date", "entity", "weight"} - set(df.columns)
    if lacking:
        raise ValueError(f"positions lack {sorted(lacking)}")
    out = df.withColumns({"date": F.col("date").cast("date"), "weight": F.expr("try_cast(weight AS DOUBLE)")})
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.where("weight IS NOT NULL AND weight <> 0")


def market_proxy(df: DataFrame, patterns: Sequence[str], value: str = "close") -> DataFrame:
    """The series whose name matches the earliest pattern, else the first by name."""
    rank = F
    for i, pattern in enumerate(patterns):
        rank = rank.when(F.col("entity").contains(pattern), i)
    names = df.select("entity").distinct().withColumn("_rank", rank.otherwise(len(patterns)))
    chosen = names.agg(F.min_by("entity", F.struct("_rank", "entity")).alias("entity"))
    return df.join(F.broadcast(chosen), "entity").where(F.col(value).isNotNull())
