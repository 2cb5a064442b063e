"""Rule-based signals from indicators: five levels from strong_buy to strong_sell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators

# Scores and display order of the levels.
SCORES = {"strong_buy": 2, "buy": 1, "neutral": 0, "sell": -1, "strong_sell": -2}
LABELS = {"strong_sell": "Strong Sell", "sell": "Sell", "neutral": "Neutral", "buy": "Buy", "strong_buy": "Strong Buy"}


def from_rsi(rsi: Column) -> Column:
    return F.when(rsi <= 20, "strong_buy").when(rsi <= 30, "buy").when(rsi >= 80, "strong_sell").when(rsi >= 70, "sell").otherwise("neutral")


def gap(price: Column, average: Column) -> Column:
    """The price's distance from an average in percent; null where the average is 0."""
    return F.try_divide(price - average, average) * 100


def from_average(price: Column, average: Column) -> Column:
    """A positive price over an average of 0 is a strong buy, as its distance has no bound."""
    d = gap(price, average)
    return (
        F.when((average == 0) & (price > 0), "strong_buy").when((average == 0) & (price < 0), "strong_sell")
        .when(d > 5, "strong_buy").when(d > 0, "buy").when(d < -5, "strong_sell").when(d < 0, "sell").otherwise("neutral")
    )


def score(signal: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SCORES.items() for x in pair))
    return F.try_element_at(table, signal)


def combine(signals: list[Column]) -> Column:
    """The level of the mean score of the signals that aren't null; neutral without any."""
    known = F.array_compact(F.array(*(score(s) for s in signals)))
    mean = F.try_divide(F.aggregate(known, F.lit(0), lambda a, x: a + x), F.size(known))
    return F.when(mean >= 1.5, "strong_buy").when(mean >= 0.5, "buy").when(mean <= -1.5, "strong_sell").when(mean <= -0.5, "sell").otherwise("neutral")


def label(signal: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), signal)


def place(signal: Column) -> Column:
    """0 for strong_sell to 4 for strong_buy."""
    return F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(LABELS) for x in (k, i))), signal)


def panel_label(price: Column, average: Column) -> Column:
    """Buy above the average, else Sell, at equality too."""
    return F.when(gap(price, average) > 0, "Buy").otherwise("Sell")


def rsi_zone(rsi: Column) -> Column:
    r = F.coalesce(rsi, F.lit(50.0))
    return F.when(r <= 20, "Strongly Oversold").when(r <= 30, "Oversold").when(r >= 80, "Strongly Overbought").when(r >= 70, "Overbought").otherwise("Neutral")


def rsi_band(rsi: Column) -> Column:
    r = F.coalesce(rsi, F.lit(50.0))
    return F.when(r <= 30, "low").when(r >= 70, "high").otherwise("mid")


def cross_text(cross: Column) -> Column:
    return F.when(cross == "golden_cross", "Golden Cross: SMA-50 crossed above SMA-200").when(cross == "death_cross", "Death Cross: SMA-50 crossed below SMA-200")


def correlation_class(r: Column) -> Column:
    return F.when(r >= 0.7, "strong_positive").when(r >= 0.3, "positive").when(r >= -0.3, "neutral").when(r >= -0.7, "negative").otherwise("strong_negative")


def latest_indicators(bars: DataFrame) -> DataFrame:
    """(symbol, price, rsi_14, sma_50, sma_200, ema_12, ema_26, cross_ts, cross) at each symbol's last bar, and its last cross.

    One window stage over slices, then partial aggregates.
    """
    numbered = indicators.positions(bars, total="n")

    def windows(cut: DataFrame) -> DataFrame:
        averaged = indicators.with_rsi(indicators.with_sma(cut, [50, 200]), 14)
        return averaged.withColumn("cross", indicators.cross_kind("sma_50", "sma_200"))

    full = indicators.in_slices(numbered, 200, windows)
    at = F.when(F.col("cross").isNotNull(), F.col("ts"))
    last = full.groupBy("symbol").agg(
        F.max_by(F.struct(F.col("close").alias("price"), "rsi_14", "sma_50", "sma_200"), "rn").alias("v"),
        *(indicators.ema_aggregate(p, last=F.col("n")).alias(f"ema_{p}") for p in (12, 26)),
        F.max(at).alias("cross_ts"), F.max_by("cross", at).alias("cross"),
    )
    return last.select("symbol", "v.*", "ema_12", "ema_26", "cross_ts", "cross")


def report(bars: DataFrame) -> DataFrame:
    """Latest indicators, the latest cross, and one signal for each symbol."""
    price = F.col("price")
    parts = [F.when(F.col("rsi_14").isNotNull(), from_rsi(F.col("rsi_14")))] + [F.when(F.col(c).isNotNull(), from_average(price, F.col(c))) for c in ("sma_50", "sma_200", "ema_12", "ema_26")]
    return latest_indicators(bars).withColumn("signal", combine(parts))


def panel(bars: DataFrame) -> DataFrame:
    """(symbol, average, value, diff, label): a row for each moving average that is there."""
    now = latest_indicators(bars)
    pairs = [("SMA 50", "sma_50"), ("SMA 200", "sma_200"), ("EMA 12", "ema_12"), ("EMA 26", "ema_26")]
    rows = now.select("symbol", "price", F.explode(F.array(*(F.struct(F.lit(n).alias("average"), F.col(c).alias("value")) for n, c in pairs))).alias("m")).select("symbol", "price", "m.*")
    return rows.where("value is not null").select("symbol", "average", "value", gap(F.col("price"), F.col("value")).alias("diff"), panel_label(F.col("price"), F.col("value")).alias("label"))
