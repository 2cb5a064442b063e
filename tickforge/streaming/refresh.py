"""Dollar volumes and spikes that are kept up to date without a rescan.

A folder holds, by day, the count and last price of each symbol, and the moments (n, mean, squared distances) of daily totals. A micro-batch touches
the days of its ticks: their last version is merged with the batch and written as version `batch`, a partition a day, and the moments lose those
days' old totals and gain the new ones. Older versions are only read, so a batch that comes twice writes the same rows again. Spikes are
scored from days and moments; ticks are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import liquidity

_DAYS = "symbol string, n long, last struct<at: struct<ts: timestamp_ntz, id: long>, price: double>, day date, batch long"
_MOMENTS = "n long, mean double, m2 double, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the last batch of each value of `by`. Versions are few, so their numbers are a small table."""
    last = rows.groupBy(*by).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*by, "batch"])


def symbol_days(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(symbol, n, last, day, batch): the newest version of each day, or the newest before a batch."""
    rows = _read(spark, f"{path}/days", _DAYS)
    return _newest(rows if before is None else rows.where(F.col("batch") < before), ["day"])


def _totals(days: DataFrame, futures: str) -> DataFrame:
    return liquidity.history(days.select("symbol", F.col("day").alias("date"), F.col("n").cast("double").alias("volume"), F.col("last.price").alias("close")), futures)


def history(spark: SparkSession, path: str, futures: str) -> DataFrame:
    """(date, total_volume) of all ticks so far."""
    return _totals(symbol_days(spark, path), futures)


def moments(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """One row (n, mean, m2) of daily totals."""
    rows = _read(spark, f"{path}/moments", _MOMENTS)
    newest = (rows if before is None else rows.where(F.col("batch") < before)).agg(F.max_by(F.struct("n", "mean", "m2"), "batch").alias("m"))
    return newest.select(*(F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast(t).alias(c) for c, t in (("n", "long"), ("mean", "double"), ("m2", "double"))))


def _shifted(n: Column, mean: Column, m2: Column, k: Column, other: Column, more: Column, sign: int) -> list[Column]:
    """Moments with those of k more values, or of k values less."""
    total = n + sign * k
    now = F.when(total > 0, (n * mean + sign * k * other) / F.when(total > 0, total)).otherwise(0.0)
    d = other - (mean if sign > 0 else now)
    spread = F.when(total > 0, d * d * (n if sign > 0 else total) * k / F.when((total if sign > 0 else n) > 0, total if sign > 0 else n)).otherwise(0.0)
    rest = m2 + sign * (more + spread)
    return [total.alias("n"), now.alias("mean"), F.when(total > 0, F.greatest(rest, F.lit(0.0))).otherwise(0.0).alias("m2")]


def upsert(ticks: DataFrame, batch: int, path: str, futures: str) -> None:
    """Takes in a batch of ticks (symbol, ts, id, price); batches are numbered upwards, and one that comes again changes nothing."""
    spark = ticks.sparkSession
    at = F.struct(F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("id").cast("long").alias("id")).alias("at"), F.col("price").cast("double").alias("price"))
    new = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    touched = new.select("day").distinct()
    old = symbol_days(spark, path, batch).join(touched, "day", "left_semi").drop("batch")
    whole = new.select("symbol", "n", "last", "day").unionByName(old.select("symbol", "n", "last", "day"))
    merged = whole.groupBy("symbol", "day").agg(F.sum("n").alias("n"), F.max("last").alias("last")).withColumn("batch", F.lit(batch).cast("long"))
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/days")
    stats = lambda df, p: _totals(df, futures).agg(F.count("*").alias(f"{p}n"), F.coalesce(F.avg("total_volume"), F.lit(0.0)).alias(f"{p}mean"), F.coalesce(F.var_pop("total_volume") * F.count("*"), F.lit(0.0)).alias(f"{p}m2"))
    mine = _read(spark, f"{path}/days", _DAYS).where(F.col("batch") == batch)
    row = moments(spark, path, batch).crossJoin(F.broadcast(stats(old, "o"))).crossJoin(F.broadcast(stats(mine, "a")))  # one row each
    less = row.select(*_shifted(F.col("n"), F.col("mean"), F.col("m2"), F.col("on"), F.col("omean"), F.col("om2"), -1), "an", "amean", "am2")
    more = less.select(*_shifted(F.col("n"), F.col("mean"), F.col("m2"), F.col("an"), F.col("amean"), F.col("am2"), 1), F.lit(batch).cast("long").alias("batch"))
    more.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/moments")


def spikes(spark: SparkSession, path: str, futures: str, **options) -> DataFrame:
    """As liquidity.spikes on all ticks so far, scored with the moments that are kept."""
    # What is left of days that are all alike is rounding.
    std = F.sqrt(F.try_divide("m2", "n"))
    m = moments(spark, path).select(F.col("mean").alias("_mean"), F.when(std > 1e-9 * F.abs("mean"), std).otherwise(0.0).alias("_std"), F.col("n").alias("_n"))
    return liquidity.spikes(history(spark, path, futures), stats=m, **options)


def start(ticks: DataFrame, path: str, checkpoint: str, futures: str, **trigger):
    """Runs upsert on a stream of ticks; give a trigger such as availableNow=True."""
    return ticks.writeStream.foreachBatch(lambda df, batch: upsert(df, batch, path, futures)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
