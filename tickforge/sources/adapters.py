"""Bars, ticks and daily totals from the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUTURES = "purchase"
DAILY_AS_OF, TICKS_AS_OF = "2001-11-04", "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str, by: str = "l_returnflag") -> DataFrame:
    """(symbol, ts, close, volume): day bars at the volume-weighted price, a symbol for each return flag, or for each value of another column of lineitem."""
    return priced(table(spark, sf_dir, "lineitem"), by)


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As daily_bars, a symbol for each brand of part."""
    return priced(table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand")


def customer_mix(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """(portfolio, symbol, weight): each customer's quantities by a column of lineitem or part, in whole percents, which may not add up to 100."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if by.startswith("p_"):
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bought = lines.groupBy(F.col("o_custkey").alias("portfolio"), F.col(by).alias("symbol")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("n"))
    total = bought.groupBy("portfolio").agg(F.sum("n").alias("total"))
    return bought.join(total, "portfolio").select("portfolio", "symbol", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("double").alias("weight"))


def priced(lines: DataFrame, by: str) -> DataFrame:
    """(symbol, ts, close, volume) of lines of orders: day bars at the volume-weighted price."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = lines.groupBy(F.col(by).alias("symbol"), F.col("l_shipdate").alias("ts"))
    return rows.agg(money("l_extendedprice").alias("value"), money("l_quantity").alias("volume")).select("symbol", "ts", F.try_divide("value", "volume").alias("close"), "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, id, price): events as ticks, a symbol for each event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def tick_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, volume, close): ticks by UTC day; volume counts them, close is the last price."""
    return ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("volume"), F.max_by("price", F.struct("ts", "id")).alias("close"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, total_volume): order totals by day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_volume"))
