"""Portfolio back-tests and risk measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import indicators, summary, timeframe


def cagr(start: Column, end: Column, years: Column) -> Column:
    """Yearly growth in percent; 0 if the years or the start aren't positive."""
    return F.when((years <= 0) | (start <= 0), 0.0).otherwise((F.pow(end / F.when(start > 0, start), 1 / F.when(years > 0, years)) - 1) * 100)


def volatility(ret: Column, per_year: int = 252) -> Column:
    """Aggregate: yearly sample deviation of returns in percent, 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * F.sqrt(F.lit(float(per_year))) * 100


def sharpe(ret: Column, risk_free: float = 0.05, per_year: int = 252) -> Column:
    """Aggregate: yearly return beyond the risk-free rate over volatility, 0 without volatility."""
    vol = volatility(ret, per_year) / 100
    return F.when(vol == 0, 0.0).otherwise(F.try_divide(F.avg(ret) * per_year - risk_free, vol))


def drawdowns(values: DataFrame, by: list[str], order: str, value: str = "value", rows: int = indicators.SLICE_ROWS) -> DataFrame:
    """values and drawdown, the distance from the highest value so far in percent; peaks are chained over slices of rows."""
    numbered = values if "rn" in values.columns else indicators.positions(values, order, tuple(by))
    found = indicators.with_peak(numbered, tuple(by), value, rows).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(value), "peak") * 100).drop("peak")
    return found if "rn" in values.columns else found.drop("rn")


def max_drawdown(values: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """(by, max_drawdown): the worst fall from a peak in percent, 0 without any; from summaries of slices that are merged in order."""
    return summary.by_series(values, by, [order], value).select(*by, summary.worst_fall(F.col("s")).alias("max_drawdown"))


def yearly(s: Column, per_year: int = 252) -> Column:
    """Of a summary: yearly deviation of returns in percent, as volatility."""
    return summary.deviation(s) * F.sqrt(F.lit(float(per_year))) * 100


def sharpe_of(s: Column, risk_free: float = 0.05, per_year: int = 252) -> Column:
    """Of a summary: as sharpe."""
    vol = yearly(s, per_year) / 100
    return F.when(vol == 0, 0.0).otherwise(F.try_divide(s["mean"] * per_year - risk_free, vol))


def risk(values: DataFrame, by: list[str], order: str, value: str = "value", risk_free: float = 0.05, per_year: int = 252) -> DataFrame:
    """(by, volatility, sharpe, max_drawdown) of each series, in one pass."""
    s = F.col("s")
    found = summary.by_series(values, by, [order], value)
    return found.select(*by, yearly(s, per_year).alias("volatility"), sharpe_of(s, risk_free, per_year).alias("sharpe"), summary.worst_fall(s).alias("max_drawdown"))


def measures(s: Column, amount: Column, years: Column, risk_free: float = 0.05, per_year: int = 252) -> list[Column]:
    """total_return, cagr, max_drawdown, volatility and sharpe of the summary of a portfolio's values."""
    last = s["last"]
    return [
        ((last - amount) / amount * 100).alias("total_return"), cagr(amount, last, years).alias("cagr"), summary.worst_fall(s).alias("max_drawdown"),
        yearly(s, per_year).alias("volatility"), sharpe_of(s, risk_free, per_year).alias("sharpe"),
    ]


def equal_weights(symbols: DataFrame) -> DataFrame:
    """(ordinal, symbol, weight) for a small table (ordinal from 1, symbol)."""
    n = symbols.agg(F.count("*").alias("n"))
    return symbols.crossJoin(F.broadcast(n)).select("ordinal", "symbol", scalar.equal_weight(F.col("n"), F.col("ordinal")).alias("weight"))


def check_weights(weights: dict[str, float]) -> None:
    """Raises ValueError unless there are weights and they add up to 100; missing ones count as 0."""
    if not weights or sum(w or 0 for w in weights.values()) != 100:
        raise ValueError("weights must add up to 100")


def weight_totals(allocations: DataFrame, by: list[str]) -> DataFrame:
    """(by, members, total_weight, is_valid) of (by, symbol, weight): as check_weights for many portfolios at once."""
    total = F.sum(F.coalesce("weight", F.lit(0.0)))
    return allocations.groupBy(*by).agg(F.count("symbol").alias("members"), total.alias("total_weight"), ((total == 100) & (F.count("symbol") > 0)).alias("is_valid"))


def simulate(bars: DataFrame, weights: dict[str, float], amount: float, start: str, end: str, align: str = "position", whole_end_day: bool = False) -> DataFrame:
    """(i, ts, value): the portfolio's value at each bar; ts is the first symbol's.

    The i-th bars of the symbols add up, cut to the shortest series (align='position'), or those of one day (align='date').
    Nothing comes back unless every symbol has two bars or more.
    """
    check_weights(weights)
    spark, first = bars.sparkSession, next(iter(weights))
    asked = F.broadcast(spark.createDataFrame([(s, float(w or 0)) for s, w in weights.items()], "symbol string, weight double"))
    part = timeframe.between_days(bars.where(F.col("symbol").isin(list(weights))), start, end, whole_end_day=whole_end_day)
    counts = asked.join(part.groupBy("symbol").agg(F.count("*").alias("n")), "symbol", "left")
    whole = F.broadcast(counts.agg(F.min(F.coalesce("n", F.lit(0))).alias("shortest")))
    grown = indicators.with_base(indicators.positions(part)).join(asked, "symbol").crossJoin(whole).where("shortest >= 2")
    key = F.col("rn") if align == "position" else F.to_date("ts")
    summed = grown.groupBy(key.alias("k")).agg(
        F.sum(F.lit(amount) * F.col("weight") / 100 * F.col("growth")).alias("value"), F.count("*").alias("n"), F.max(F.when(F.col("symbol") == first, F.col("ts"))).alias("ts")
    ).where(F.col("n") == len(weights))
    if align == "date":  # days are numbered by month, then in their month
        summed = indicators.positions(summed, "k", (), "month").withColumn("k", F.col("rn"))
    return summed.select(F.col("k").cast("long").alias("i"), "ts", "value")


def metrics(values: DataFrame, amount: float, start: str, end: str, risk_free: float = 0.05, per_year: int = 252) -> DataFrame:
    """One row of total_return, cagr, max_drawdown, volatility, sharpe for (i, value); none without values."""
    years = scalar.year_fraction(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    found = summary.by_series(values.select(F.lit(0).alias("one"), "i", "value"), ["one"], ["i"], "value")
    return found.select(*measures(F.col("s"), F.lit(float(amount)), years, risk_free, per_year))


def classes(found: DataFrame) -> DataFrame:
    """metrics and whether return and yearly growth are positive (0 is) and the Sharpe ratio is good (1 or more)."""
    return found.withColumns({"return_class": scalar.sign_class(F.col("total_return")), "cagr_class": scalar.sign_class(F.col("cagr")), "sharpe_class": F.when(F.col("sharpe") >= 1, "good").otherwise("weak")})
