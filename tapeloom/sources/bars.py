"""Daily bars and companion tables derived from the order-line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.rolling import ordered, shifted


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def trades(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as weekday trades: price, quantity and a total order within a day."""
    lines = table(spark, root, "lineitem")
    day = F.col("l_shipdate").cast("date")
    price = F.lit(100.0) + F.col("l_extendedprice") / 1000
    return lines.where(F.weekday(day) < 5).select(
        day.alias("date"),
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        price.alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", price.alias("price")).alias("seq"),
    )


def to_bars(df: DataFrame, entity: Column | str) -> DataFrame:
    """Aggregate trades to one bar per entity and day, combining map-side."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.groupBy(entity.alias("entity"), "date").agg(
        F.min("seq")["price"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max("seq")["price"].alias("close"),
        F.sum("quantity").alias("volume"),
        F.round(F.sum(F.col("price") * F.col("quantity")), 5).alias("total_turnover"),
        F.count(F.lit(1)).cast("double").alias("num_trades"),
    )


def brand_bars(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select("p_partkey", "p_brand")
    joined = trades(spark, root).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return to_bars(joined, "p_brand")


def supplier_bars(spark: SparkSession, root: str) -> DataFrame:
    # Most suppliers trade once a day at most, so nearly every line is shuffled: by the number, not its text.
    return to_bars(trades(spark, root), "l_suppkey").withColumn("entity", F.col("entity").cast("string"))


def brand_groups(spark: SparkSession, root: str) -> DataFrame:
    """Brand to sector: the brand number modulo five."""
    return (
        table(spark, root, "part")
        .select(F.col("p_brand").alias("entity"))
        .distinct()
        .select("entity", F.concat(F.lit("S"), F.split("entity", "#")[1].cast("int") % 5).alias("sector"))
    )


def supplier_groups(spark: SparkSession, root: str) -> DataFrame:
    """Supplier to region (five sectors) and nation (twenty-five industries)."""
    supplier, nation, region = (table(spark, root, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("entity"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
        )
    )


def index_bars(spark: SparkSession, root: str) -> DataFrame:
    """Three turnover-weighted index series, one per return flag, with the previous close."""
    worth = F.col("price") * F.col("quantity")
    daily = (
        trades(spark, root)
        .groupBy(F.col("l_returnflag").alias("entity"), "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.round(F.try_divide(F.sum(F.col("price") * worth), F.sum(worth)), 6).alias("close"),
            F.round(F.sum(worth), 5).alias("total_turnover"),
        )
    )
    return daily.withColumn("prev_close", shifted("close", 1, ordered()))


def calendar_days(spark: SparkSession, root: str) -> DataFrame:
    return trades(spark, root).select("date").distinct()


def master(bars: DataFrame) -> DataFrame:
    """First bar as listing date; last bar as delisting date if 60+ days before the panel ends."""
    spans = bars.groupBy("entity").agg(F.min("date").alias("ipo_date"), F.max("date").alias("last_date"))
    end = spans.agg(F.max("last_date").alias("panel_end"))
    gone = F.datediff("panel_end", "last_date") >= 60
    return spans.join(F.broadcast(end), F.lit(True)).select(
        "entity", "ipo_date", F.when(gone, F.col("last_date")).alias("delist_date")
    )
