"""Ranges and granularities of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days back, bar width, and bar width of liquidity histories, for each range.
RANGE_DAYS = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "6M": 180, "1Y": 365, "5Y": 1825}
ALL_SINCE = "2000-01-01"
RANGE_INTERVALS = {"1D": "5m", "1W": "15m", "1M": "1d", "3M": "1d", "6M": "1d", "1Y": "1d", "5Y": "1wk", "ALL": "1mo"}
HISTORY_INTERVALS = {"5Y": "1wk", "ALL": "1mo"}
TRUNC = {"1h": "hour", "1d": "day", "1wk": "week", "1mo": "month"}
MINUTES = {"1m": 1, "5m": 5, "15m": 15}


def interval_for(range_name: str, override: str | None = None) -> str:
    """The bar width of a range, or the override, which must be a known width."""
    if override is not None:
        if override not in TRUNC and override not in MINUTES:
            raise ValueError(f"unknown interval {override}")
        return override
    return RANGE_INTERVALS.get(range_name, "1d")


def history_interval(range_name: str) -> str:
    return HISTORY_INTERVALS.get(range_name, "1d")


def in_range(bars: DataFrame, range_name: str, as_of: str, ts: str = "ts") -> DataFrame:
    """Rows from the range's first moment to as_of. Unknown ranges are a month. The bare column is compared, so the scan prunes."""
    return bars.where((F.col(ts) >= range_start(range_name, as_of)) & (F.col(ts) <= F.lit(as_of).cast("timestamp_ntz")))


def range_start(range_name: str, as_of: str) -> Column:
    if range_name == "ALL":
        return F.lit(ALL_SINCE).cast("timestamp_ntz")
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {RANGE_DAYS.get(range_name, 30)} days")


def between_days(bars: DataFrame, start: str, end: str, ts: str = "ts", whole_end_day: bool = False) -> DataFrame:
    """Rows from midnight of start to midnight of end, both included; whole_end_day takes in all of the last day."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if whole_end_day:
        return bars.where((F.col(ts) >= lo) & (F.col(ts) < hi + F.expr("interval 1 day")))
    return bars.where((F.col(ts) >= lo) & (F.col(ts) <= hi))


def resample(ticks: DataFrame, interval: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, n) bars of ticks (symbol, ts, id, price[, volume]); partial sums before the shuffle."""
    if interval in MINUTES:
        bucket = F.window("ts", f"{MINUTES[interval]} minutes")["start"]
    else:
        bucket = F.date_trunc(TRUNC[interval], "ts")
    order = F.struct("ts", "id")
    volume = F.sum("volume") if "volume" in ticks.columns else F.count("*").cast("double")
    return ticks.groupBy("symbol", bucket.cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), volume.alias("volume"), F.count("*").alias("n")
    ).withColumnRenamed("bar_ts", "ts")


def bars_for_range(ticks: DataFrame, range_name: str, as_of: str, interval: str | None = None) -> DataFrame:
    """Bars of a range at its own width, or at `interval`; the range is cut before bars are made."""
    return resample(in_range(ticks, range_name, as_of), interval_for(range_name, interval))


WIDTHS = ("1m", "5m", "15m", "1h", "1d", "1wk", "1mo")


def bucket(ts: Column, interval: str) -> Column:
    """The first moment of the bar that a time is in."""
    if interval in MINUTES:
        return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * MINUTES[interval])) * 60 * MINUTES[interval]).cast("timestamp_ntz")
    return F.date_trunc(TRUNC[interval], ts).cast("timestamp_ntz")


def states(ticks: DataFrame, interval: str, by: list[str]) -> DataFrame:
    """(by, bar_ts, state) of ticks: bars that can still be merged, as first and last price have their place with them."""
    place = F.struct("ts", "id")
    volume = F.sum("volume") if "volume" in ticks.columns else F.count("*").cast("double")
    first, last = F.min(F.struct(place.alias("at"), F.col("price").alias("price"))), F.max(F.struct(place.alias("at"), F.col("price").alias("price")))
    found = ticks.groupBy(*by, bucket(F.col("ts"), interval).alias("bar_ts"))
    return found.agg(F.struct(first.alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("last"), volume.alias("volume"), F.count("*").alias("n")).alias("state"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, open, high, low, close, volume, n): bars of states with equal `by`."""
    s = F.col("state")
    found = parts.groupBy(*by).agg(F.min(s["first"]).alias("_first"), F.max(s["high"]).alias("high"), F.min(s["low"]).alias("low"), F.max(s["last"]).alias("_last"), F.sum(s["volume"]).alias("volume"), F.sum(s["n"]).alias("n"))
    return found.select(*by, F.col("_first.price").alias("open"), "high", "low", F.col("_last.price").alias("close"), "volume", "n")


def resample_all(ticks: DataFrame, intervals: list[str]) -> DataFrame:
    """(symbol, width, ts, open, high, low, close, volume, n): bars of several widths in one pass. Ticks are read and shuffled once, into bars of the finest width; wider bars merge those."""
    finest = min(intervals, key=WIDTHS.index)
    wider = F.explode(F.array(*(F.struct(F.lit(i).alias("width"), bucket(F.col("bar_ts"), i).alias("ts")) for i in intervals)))
    cut = states(ticks, finest, ["symbol"]).select("symbol", wider.alias("w"), "state").select("symbol", "w.width", "w.ts", "state")
    return merged(cut, ["symbol", "width", "ts"])


def bars_for_ranges(ticks: DataFrame, asked: list[tuple[str, str | None]], as_of: str) -> DataFrame:
    """(range, width, symbol, ts, open, ...): as bars_for_range for each (range, width or None) asked, from one scan, cut to the longest range.

    A range may start within a bar of the finest width, so ticks are told apart by how many of the ranges they are in.
    """
    asked = [(name, interval_for(name, i)) for name, i in asked]
    starts = {name: range_start(name, as_of) for name, _ in asked}
    end, ts = F.lit(as_of).cast("timestamp_ntz"), F.col("ts")
    kept = ticks.where((ts >= F.least(*starts.values()) if len(starts) > 1 else ts >= next(iter(starts.values()))) & (ts <= end))
    inside = F.array_compact(F.array(*(F.when(ts >= start, F.lit(name)) for name, start in starts.items())))
    finest = min((i for _, i in asked), key=WIDTHS.index)
    cut = states(kept.withColumn("ranges", inside), finest, ["symbol", "ranges"])
    bars = F.array_compact(F.array(*(F.when(F.array_contains("ranges", name), F.struct(F.lit(name).alias("range"), F.lit(i).alias("width"), bucket(F.col("bar_ts"), i).alias("ts"))) for name, i in asked)))
    return merged(cut.select("symbol", F.explode(bars).alias("w"), "state").select("w.range", "w.width", "symbol", "w.ts", "state"), ["range", "width", "symbol", "ts"])


def coarsen(bars: DataFrame, interval: str) -> DataFrame:
    """Wider bars from bars (symbol, ts, close, volume)."""
    return bars.groupBy("symbol", F.date_trunc(TRUNC[interval], "ts").cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("close", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bar_ts", "ts")
