"""A store of bars that indicators read without a shuffle.

Bars are numbered and cut into slices once, when they are written: a table bucketed by (symbol, slice), sorted within, and partitioned by year. Each
slice has the `lookback` rows before it too, marked as extra. Windows by (symbol, slice) so find their rows together, whatever the query, and a
range of time reads only its years' files and, as those are sorted, their row groups.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indicators, timeframe

LOOKBACK = 1024
_KEYS = ("slice", "extra", "rn", "gaps", "year")


def write(bars: DataFrame, name: str | None = None, lookback: int = LOOKBACK, rows: int = indicators.SLICE_ROWS, buckets: int | None = None) -> str:
    """Writes bars (symbol, ts, close, ...), one a symbol and moment, as a table, and returns its name. An existing table of that name is an error.

    Indicators look back `lookback` rows at most. gaps is how many closes are missing in earlier slices: they end exponential averages.
    """
    if not 1 <= lookback <= rows:
        raise ValueError("a slice must hold the rows looked back on")
    spark = bars.sparkSession
    name = name or f"bars_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = indicators.sliced(indicators.positions(bars), lookback, rows).withColumn("slice", F.col("slice").cast("long"))
    missing = cut.where("not extra").groupBy("symbol", "slice").agg(F.sum(F.col("close").isNull().cast("long")).alias("_missing"))
    before = F.coalesce(F.sum("_missing").over(Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = cut.join(missing.select("symbol", "slice", before.alias("gaps")), ["symbol", "slice"]).withColumn("year", F.year("ts"))
    whole = whole.repartition(buckets, "symbol", "slice")
    whole.write.partitionBy("year").bucketBy(buckets, "symbol", "slice").sortBy("symbol", "slice", "rn").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('lookback' = '{lookback}')")
    return name


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def lookback(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name} ('lookback')").first()["value"])


def slices(spark: SparkSession, name: str) -> DataFrame:
    """All rows by slices, extra ones too: what windows by (symbol, slice) need."""
    return spark.table(name)


def bars(spark: SparkSession, name: str) -> DataFrame:
    """Each bar once, as written."""
    found = spark.table(name).where("not extra")
    return found.drop(*_KEYS)


def in_range(spark: SparkSession, name: str, range_name: str, as_of: str) -> DataFrame:
    """Bars of a range; years without any are not read."""
    return timeframe.in_range(_years(spark.table(name), timeframe.range_start(range_name, as_of), F.lit(as_of).cast("timestamp_ntz")).where("not extra"), range_name, as_of).drop(*_KEYS)


def between_days(spark: SparkSession, name: str, start: str, end: str) -> DataFrame:
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return timeframe.between_days(_years(spark.table(name), lo, hi).where("not extra"), start, end).drop(*_KEYS)


def _years(stored: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return stored.where((F.col("year") >= F.year(lo)) & (F.col("year") <= F.year(hi)))


def reach(period: int) -> int:
    """Rows after which an exponential average has forgotten where it started, in double precision."""
    return math.ceil(math.log(indicators.LEAST_WEIGHT) / math.log(1 - 2 / (period + 1))) if period > 1 else 1


def with_ema(stored: DataFrame, periods: list[int], price: str = "close") -> DataFrame:
    """ema_<period> on slices of a store, from the rows before each that it has; as indicators.with_ema."""
    kept = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        x, first = pc.fill_null(t.column(price).cast(pa.float64()), float("nan")).to_numpy(), t.column("rn")[0].as_py()
        for p in periods:
            k, found = 2 / (p + 1), np.full(len(x), np.nan)
            if first > 1:
                found[0] = x[0]
                found[1:] = indicators.averages(x[1:], k, x[0])
            elif len(x) >= p:
                found[p - 1] = x[:p].mean()
                found[p:] = indicators.averages(x[p:], k, found[p - 1])
            if t.column("gaps")[0].as_py():
                found[:] = np.nan
            t = t.append_column(f"ema_{p}", pa.array(found, mask=np.isnan(found)))
        return t

    return stored.groupBy("symbol", "slice").applyInArrow(fill, kept + ", " + ", ".join(f"ema_{p} double" for p in periods))


def with_indicators(spark: SparkSession, name: str, sma: list[int] = (), rsi: list[int] = (), ema: list[int] = (), price: str = "close") -> DataFrame:
    """The store's bars with sma_, rsi_ and ema_ columns for the periods asked; nothing is shuffled. Periods must fit the store's lookback."""
    needed = max([*(p - 1 for p in sma), *rsi, *map(reach, ema)], default=0)
    if needed > lookback(spark, name):
        raise ValueError(f"the store looks back {lookback(spark, name)} rows, {needed} are needed")
    found = slices(spark, name)
    if sma:
        found = indicators.with_sma(found, list(sma), price)
    for p in rsi:
        found = indicators.with_rsi(found, p, price)
    if ema:  # last: what comes out of Python isn't known to be bucketed
        found = with_ema(found, list(ema), price)
    return found.where("not extra").drop(*_KEYS)
