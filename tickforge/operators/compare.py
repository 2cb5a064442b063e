"""Comparison of symbols: normalised series, returns by period, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import correlation, indicators, signals

# Periods of the returns table, in days.
PERIODS = {"1W": 7, "1M": 30, "3M": 90, "6M": 180, "1Y": 365}


def normalized(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, a column of percent change since the first bar for each symbol): a day's last bar counts; days are the union of all."""
    based = indicators.with_base(bars.where(F.col("symbol").isin(symbols)))
    daily = based.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("pct", "ts").alias("pct"))
    return daily.groupBy("date").pivot("symbol", symbols).agg(F.first("pct"))


def period_returns(bars: DataFrame, as_of: str, periods: dict[str, int] = PERIODS) -> DataFrame:
    """(symbol, ret_<period> in percent): one scan; null where a period has fewer than two bars."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = bars.where((F.col("ts") >= end - F.expr(f"interval {max(periods.values())} days")) & (F.col("ts") <= end))
    aggs = []
    for name, days in periods.items():
        at = F.when(F.col("ts") >= end - F.expr(f"interval {days} days"), F.col("ts"))
        aggs += [F.min_by("close", at).alias(f"first_{name}"), F.max_by("close", at).alias(f"last_{name}"), F.count(at).alias(f"n_{name}")]
    found = recent.groupBy("symbol").agg(*aggs)
    return found.select("symbol", *(F.when(F.col(f"n_{p}") >= 2, F.try_divide(F.col(f"last_{p}") - F.col(f"first_{p}"), f"first_{p}") * 100).alias(f"ret_{p}") for p in periods))


def correlation_matrix(bars: DataFrame, align: str = "position", symbols: int | None = None) -> DataFrame:
    """(sym_a, sym_b, n, corr, class) of returns, both triangles and the diagonal; no rows for fewer than two symbols.

    align='position' pairs the i-th returns of two symbols, cut to the shorter; align='date' pairs days. By tiles (see correlation);
    symbols, rows and the reach of positions are counted first, unless the number of symbols is given.
    """
    day, extent = F.datediff("ts", F.lit("1970-01-01").cast("date")), None
    if symbols is None:
        each = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))
        size = each.agg(F.count("symbol").alias("symbols"), F.sum("n").alias("rows"), F.max("n").alias("longest"), F.min("first").alias("first"), F.max("last").alias("last")).first()
        symbols = size.symbols
        if symbols >= 2 and size.first is not None:
            extent = (size.rows, 2, max(2, size.longest)) if align == "position" else (size.rows, size.first, size.last)
    if symbols < 2:
        bars = bars.limit(0)
    rets = indicators.with_returns(indicators.positions(bars)).where("rn > 1")
    key = F.col("rn") if align == "position" else day
    pairs = correlation.correlations(rets.select("symbol", key.alias("k"), F.col("ret").alias("x")), symbols, extent=extent, both=True)
    return pairs.select("sym_a", "sym_b", "n", "corr", signals.correlation_class(F.col("corr")).alias("class"))
