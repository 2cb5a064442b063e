"""Dollar volume: snapshots, histories, proportional splits, and volume spikes explained by events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims, static_tables
from . import indicators, timeframe

SPIKE, MIN_DAYS, TOP, REACH_DAYS = 1.2, 10, 6, 3


def multiplier(symbol: Column, futures: str, contract: float = 100.0) -> Column:
    """A futures contract counts `contract` times, all else once."""
    return F.when(symbol == futures, F.lit(contract)).otherwise(F.lit(1.0))


def history(days: DataFrame, futures: str) -> DataFrame:
    """(date, total_volume) of (symbol, date, volume, close): dollar volume over all symbols, partial sums before the shuffle."""
    value = F.col("volume") * F.col("close") * multiplier(F.col("symbol"), futures)
    return days.groupBy("date").agg(F.sum(value).alias("total_volume"))


def history_for_range(days: DataFrame, range_name: str, as_of: str, futures: str) -> DataFrame:
    """history of (symbol, date, volume, close) over a range, by days, weeks or months as the range wants: volumes add up, the last close counts."""
    bars = timeframe.in_range(days.withColumn("ts", F.col("date").cast("timestamp_ntz")), range_name, as_of)
    interval = timeframe.history_interval(range_name)
    wide = bars if interval == "1d" else timeframe.coarsen(bars, interval)
    return history(wide.select("symbol", F.to_date("ts").alias("date"), "volume", "close"), futures)


def history_for_ranges(days: DataFrame, ranges: list[str], as_of: str, futures: str) -> DataFrame:
    """(range, date, total_volume): as history_for_range for several ranges, from one reading of days."""
    ts, end = F.col("date").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")
    bars = F.array_compact(F.array(*(F.when(ts >= timeframe.range_start(k, as_of), F.struct(F.lit(k).alias("range"), F.to_date(timeframe.bucket(ts, timeframe.history_interval(k))).alias("bar"))) for k in ranges)))
    cut = days.where(ts <= end).select("symbol", "date", "volume", "close", F.explode(bars).alias("w"))
    wide = cut.groupBy("w.range", F.col("w.bar").alias("bar"), "symbol").agg(F.sum("volume").alias("volume"), F.max_by("close", "date").alias("close"))
    value = F.col("volume") * F.col("close") * multiplier(F.col("symbol"), futures)
    return wide.groupBy("range", F.col("bar").alias("date")).agg(F.sum(value).alias("total_volume"))


def split_columns(days: DataFrame, total: str = "total_volume") -> DataFrame:
    """A column for each demand source, by name."""
    return days.withColumns({key: F.col(total) * (percent / 100) for key, _, percent, _ in static_tables.SOURCES})


def split_rows(total: DataFrame) -> DataFrame:
    """(name, value, percent, color) for a one-row table (total)."""
    s = F.broadcast(dims.sources(total.sparkSession))
    return total.crossJoin(s).select("ordinal", "name", (F.col("total") * F.col("percent") / 100).alias("value"), "percent", "color")


def summary(days: DataFrame) -> DataFrame:
    """One row: total_volume, avg_daily_volume, trading_days and the total's share of each source; zeros without days."""
    one = days.agg(F.coalesce(F.sum("total_volume"), F.lit(0.0)).alias("total_volume"), F.coalesce(F.avg("total_volume"), F.lit(0.0)).alias("avg_daily_volume"), F.count("*").alias("trading_days"))
    return split_columns(one)


def snapshot(quotes: DataFrame, futures: str, names: dict[str, str] | None = None) -> DataFrame:
    """(symbol, name, volume, dollar_volume, price) of (symbol, short_name, price, volume); futures count at 100 times their price, 0 if it isn't known."""
    known = F.create_map(*(F.lit(x) for pair in (names or {s: n for s, n, _ in static_tables.INSTRUMENTS}).items() for x in pair))
    value = F.col("volume") * F.coalesce("price", F.lit(0.0)) * multiplier(F.col("symbol"), futures)
    return quotes.select("symbol", F.coalesce(F.try_element_at(known, F.col("symbol")), "short_name").alias("name"), "volume", value.alias("dollar_volume"), "price")


def futures_price(quotes: DataFrame, futures: str) -> DataFrame:
    """One row: the futures' price, 0 without a quote. Only that symbol's quotes are read."""
    return quotes.where(F.col("symbol") == futures).agg(F.coalesce(F.max("price"), F.lit(0.0)).alias("price"))


def scale_regions(total: DataFrame) -> DataFrame:
    """Nested regions whose countries have a volume, their share of a one-row total (total)."""
    r = F.broadcast(dims.regions(total.sparkSession))
    scaled = F.transform("countries", lambda c: c.withField("volume", F.col("total") * c["percent"] / 100))
    return total.crossJoin(r).select("region", "percent", "color", scaled.alias("countries"))


def countries(regions: DataFrame) -> DataFrame:
    """(region, country, flag, percent, volume), one row a country."""
    return regions.select("region", F.explode("countries").alias("c")).select("region", "c.country", "c.flag", "c.percent", "c.volume")


def demand(regions: DataFrame) -> DataFrame:
    """(region, country, type, percent, color, volume), one row for each kind of demand of a country."""
    flat = regions.select("region", F.explode("countries").alias("c")).select("region", "c.country", F.col("c.volume").alias("_v"), F.explode("c.breakdown").alias("b"))
    return flat.select("region", "country", "b.type", "b.percent", "b.color", (F.col("_v") * F.col("b.percent") / 100).alias("volume"))


def spikes(days: DataFrame, top: int | None = TOP, least: float = SPIKE, min_days: int = MIN_DAYS, stats: DataFrame | None = None) -> DataFrame:
    """(date, total_volume, deviation): the `top` days (all if None) furthest above the mean, over `least` population deviations; earlier days win ties.

    None for fewer than `min_days` days or days that are all alike. Mean and deviation are one row (stats: _mean, _std, _n, if they are known), joined, so no window spans all days.
    """
    if stats is None:
        stats = days.agg(F.avg("total_volume").alias("_mean"), F.stddev_pop("total_volume").alias("_std"), F.count("*").alias("_n"))
    scored = days.crossJoin(F.broadcast(stats)).where((F.col("_n") >= min_days) & (F.col("_std") > 0)).withColumn("deviation", F.try_divide(F.col("total_volume") - F.col("_mean"), "_std"))
    found = scored.where(F.col("deviation") > least).select("date", "total_volume", "deviation")
    return found.orderBy(F.desc("deviation"), "date").limit(top) if top else found


def numbered(top: DataFrame) -> DataFrame:
    """Spikes in order of their days, numbered from 1: days of a year are numbered in it, behind those of the years before, so any number of them will do."""
    return indicators.positions(top, "date", (), "year").withColumn("number", F.col("rn").cast("int")).drop("rn")


def nearest_event(days: DataFrame, events: DataFrame | None = None, reach: int = REACH_DAYS) -> DataFrame:
    """days (date, ...) and the event nearest to each within `reach` days, else a default text; the event listed first wins ties.

    Each event is put on the days it reaches, so the join is on equal days.
    """
    fixed = events is None  # 52 events, so at most 52 * (2 * reach + 1) days
    near = (dims.events(days.sparkSession) if fixed else events).select(F.explode(F.sequence(F.date_sub("event_date", reach), F.date_add("event_date", reach))).alias("date"), "event_date", "ordinal", "title", "description")
    best = near.groupBy("date").agg(F.min_by(F.struct("event_date", "title", "description"), F.struct(F.abs(F.datediff("date", "event_date")), "ordinal")).alias("e"))
    title, text = static_tables.DEFAULT_EVENT
    return days.join(F.broadcast(best) if fixed else best, "date", "left").select(
        *days.columns, F.col("e.event_date").alias("event_date"), F.coalesce("e.title", F.lit(title)).alias("title"), F.coalesce("e.description", F.lit(text)).alias("description")
    )
