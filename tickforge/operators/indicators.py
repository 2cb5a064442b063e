"""Time-series indicators for all symbols in one plan.

Windows are partitioned by symbol and slice: each series is cut into slices of rows, each with the rows before it that a
window looks back on, so that one symbol with a third of all rows is many tasks. What runs over a whole series
(exponential averages, peaks) is chained over slices by one row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 16
#: What an exponential average keeps of older rows counts down to this share; less can't be told in double precision.
LEAST_WEIGHT = 1e-20


def positions(bars: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("symbol",), bucket: str = "day", tie: str | None = None, total: str | None = None) -> DataFrame:
    """bars and rn, the row's number in its symbol from 1: counts by day (or a wider bucket) are summed up first, then rows are numbered in their day (`tie` orders rows of one moment).

    No task sees more than one symbol's days or one day's rows. `total` names a column for how many rows the symbol has, from the same counts.
    """
    day = F.date_trunc(bucket, ts)
    before = bars.groupBy(*by, day.alias("_day")).agg(F.count("*").alias("_n"))
    whole = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    before = before.select(*by, "_day", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_day")) - F.col("_n")).alias("_before"), *whole)
    within = F.row_number().over(Window.partitionBy(*by, "_day").orderBy(*([ts, tie] if tie else [ts])))
    return bars.withColumn("_day", day).join(before, [*by, "_day"]).withColumn("rn", F.col("_before") + within).drop("_day", "_before")


def sliced(bars: DataFrame, lookback: int, rows: int = SLICE_ROWS) -> DataFrame:
    """bars (with rn) and slice, and copies (extra) of the `lookback` rows before each slice. Windows go by (symbol, slice); then drop extra rows."""
    own = F.floor((F.col("rn") - 1) / rows)
    last = F.floor((F.col("rn") - 1 + lookback) / rows)
    return bars.withColumn("slice", F.explode(F.sequence(own, last))).withColumn("extra", F.col("slice") > own)


def in_slices(bars: DataFrame, lookback: int, compute: Callable[[DataFrame], DataFrame], ts: str = "ts", rows: int | None = None) -> DataFrame:
    """compute(bars cut into slices), without the extra rows and helper columns. bars that are cut already are left so."""
    if "slice" in bars.columns:
        return compute(bars)
    numbered = bars if "rn" in bars.columns else positions(bars, ts)
    found = compute(sliced(numbered, lookback, rows or SLICE_ROWS)).where("not extra").drop("slice", "extra")
    return found if "rn" in bars.columns else found.drop("rn")


def by_slice(ts: str = "ts"):
    return Window.partitionBy("symbol", "slice").orderBy(ts)


def with_sma(bars: DataFrame, periods: list[int], price: str = "close", ts: str = "ts") -> DataFrame:
    """sma_<period>: mean of the last `period` prices, null until there are as many."""
    w = by_slice(ts)
    return in_slices(bars, max(periods) - 1, lambda cut: cut.withColumns({f"sma_{p}": F.when(F.col("rn") >= p, F.avg(price).over(w.rowsBetween(-(p - 1), 0))) for p in periods}), ts)


def with_change(bars: DataFrame, price: str = "close", ts: str = "ts") -> DataFrame:
    return in_slices(bars, 1, lambda cut: cut.withColumn("change", F.col(price) - F.lag(price).over(by_slice(ts))), ts)


def with_rsi(bars: DataFrame, period: int = 14, price: str = "close", ts: str = "ts") -> DataFrame:
    """rsi_<period> from plain means of the last `period` gains and losses; 100 without losses, null until there are enough changes."""
    w = by_slice(ts)
    frame = w.rowsBetween(-(period - 1), 0)
    gain = F.sum(F.greatest("_c", F.lit(0.0))).over(frame) / period
    loss = F.sum(F.greatest(-F.col("_c"), F.lit(0.0))).over(frame) / period
    rsi = F.when(F.col("rn") <= period, None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return in_slices(bars, period, lambda cut: cut.withColumn("_c", F.col(price) - F.lag(price).over(w)).withColumn(f"rsi_{period}", rsi).drop("_c"), ts)


def with_returns(bars: DataFrame, price: str = "close", ts: str = "ts") -> DataFrame:
    """ret: change over the price before; null for a symbol's first row or where that price is 0."""
    before = F.lag(price).over(by_slice(ts))
    return in_slices(bars, 1, lambda cut: cut.withColumn("ret", F.try_divide(F.col(price) - before, before)), ts)


def with_base(bars: DataFrame, price: str = "close", ts: str = "ts") -> DataFrame:
    """growth (price over the symbol's first) and pct (change since then in percent). The firsts are a small table joined back."""
    first = bars.groupBy("symbol").agg(F.min_by(price, ts).alias("_base"))
    return bars.join(first, "symbol").withColumns({"growth": F.try_divide(price, "_base"), "pct": F.try_divide(F.col(price) - F.col("_base"), F.col("_base")) * 100}).drop("_base")


def with_peak(values: DataFrame, by: tuple[str, ...], value: str = "value", rows: int = SLICE_ROWS) -> DataFrame:
    """values (with rn) and peak, the highest value so far: the peaks of whole slices, one row each, come before those within a slice."""
    cut = values.withColumn("slice", F.floor((F.col("rn") - 1) / rows))
    tops = cut.groupBy(*by, "slice").agg(F.max(value).alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    within = F.max(value).over(Window.partitionBy(*by, "slice").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    started = cut.join(tops.select(*by, "slice", earlier.alias("_before")), [*by, "slice"])
    return started.withColumn("peak", F.greatest("_before", within)).drop("slice", "_before")


def cross_kind(short: str, long: str, ts: str = "ts") -> Column:
    w = by_slice(ts)
    s, l, ps, pl = F.col(short), F.col(long), F.lag(short).over(w), F.lag(long).over(w)
    return F.when((ps <= pl) & (s > l), "golden_cross").when((ps >= pl) & (s < l), "death_cross")


def crosses(bars: DataFrame, short: str = "sma_50", long: str = "sma_200", ts: str = "ts") -> DataFrame:
    """Rows at which the short average goes above (golden_cross) or below (death_cross) the long one, as column cross."""
    return in_slices(bars, 1, lambda cut: cut.withColumn("cross", cross_kind(short, long, ts)), ts).where(F.col("cross").isNotNull())


def average_crosses(bars: DataFrame, short: int = 50, long: int = 200, price: str = "close", ts: str = "ts") -> DataFrame:
    """bars with both averages at their crosses; slices are cut once, with a row more than the longer average looks back on."""
    found = in_slices(bars, max(short, long), lambda cut: with_sma(cut, [short, long], price, ts).withColumn("cross", cross_kind(f"sma_{short}", f"sma_{long}", ts)), ts)
    return found.where(F.col("cross").isNotNull())


def recent_cross(found: DataFrame, ts: str = "ts") -> DataFrame:
    return found.groupBy("symbol").agg(F.max(ts).alias("cross_ts"), F.max_by("cross", ts).alias("cross"))


def ema_aggregate(period: int, price: str = "close", last: Column | None = None) -> Column:
    """Aggregate over rows (rn, price) of a symbol: the exponential average at row number `last`, null if it has fewer rows or a missing price.

    Each price has its weight written out, so partial sums do it: no series is ever in one array.
    """
    k = 2.0 / (period + 1)
    n, rn, x = F.max(last) if last is not None else F.max("rn"), F.col("rn"), F.col(price)
    age = last - rn if last is not None else None
    later = F.sum(F.when(rn > period, x * k * F.pow(F.lit(1 - k), age)))
    seed = F.avg(F.when(rn <= period, x)) * F.pow(F.lit(1 - k), n - period)
    return F.when((n >= period) & (F.count(x) == F.count(F.lit(1))), F.coalesce(later, F.lit(0.0)) + seed)


def with_last(numbered: DataFrame) -> DataFrame:
    """numbered (symbol, rn, ...) and n, its symbol's number of rows. One row a symbol is joined back."""
    return numbered.join(numbered.groupBy("symbol").agg(F.max("rn").alias("n")), "symbol")


def latest_ema(bars: DataFrame, period: int, price: str = "close", ts: str = "ts") -> DataFrame:
    """(symbol, ema): the last exponential average of each symbol."""
    numbered = with_last(bars) if "rn" in bars.columns else positions(bars, ts, total="n")
    return numbered.groupBy("symbol").agg(ema_aggregate(period, price, F.col("n")).alias("ema"))


def averages(x: np.ndarray, k: float, start: float, block: int = 64) -> np.ndarray:
    """Exponential averages of x after `start`, a block of rows at a time; nan from the first nan on."""
    gaps = np.flatnonzero(np.isnan(x))
    if len(gaps):
        return np.concatenate([averages(x[: gaps[0]], k, start, block), np.full(len(x) - gaps[0], np.nan)])
    power = (1 - k) ** np.arange(block + 1)
    weights = np.tril(k * power[np.maximum(np.subtract.outer(np.arange(block), np.arange(block)), 0)])
    whole = len(x) // block * block
    local = (x[:whole].reshape(-1, block) @ weights.T).tolist() + ([(weights[: len(x) - whole, : len(x) - whole] @ x[whole:]).tolist()] if whole < len(x) else [])
    out = []
    for part in local:
        out.append(np.asarray(part) + power[1 : len(part) + 1] * start)
        start = out[-1][-1]
    return np.concatenate(out) if out else np.zeros(0)


def _carry(keep: float) -> Callable[[Column, Column], Column]:
    return lambda average, added: average * keep + added


def with_ema(bars: DataFrame, periods: list[int], price: str = "close", ts: str = "ts", rows: int | None = None) -> DataFrame:
    """ema_<period>: exponential averages, seeded by the mean of the first `period` prices, null before; a missing price makes all later ones null.

    An average is linear in the one before a slice: what each whole slice adds is a weighted sum, and how much it leaves of
    the average before it is a power. Those few rows are chained over as many slices as still weigh, and then each slice
    computes its rows from its start, in one pass over arrays of a slice.
    """
    rows = rows or SLICE_ROWS
    if rows < max(periods):
        raise ValueError("a slice must hold the longest period")
    numbered = bars if "rn" in bars.columns else positions(bars, ts)
    cut = numbered.withColumn("slice", F.floor((F.col("rn") - 1) / rows).cast("long"))
    age, first = (F.col("slice") + 1) * rows - F.col("rn"), F.col("slice") == 0
    sums, starts = [], []
    for p in periods:
        k = 2.0 / (p + 1)
        seed = F.avg(F.when(first & (F.col("rn") <= p), F.col(price))) * (1 - k) ** (rows - p)
        added = F.sum(F.when(~first | (F.col("rn") > p), F.col(price) * k * F.pow(F.lit(1 - k), age)))
        whole = F.count(price) == F.count(F.lit(1))
        sums.append(F.when(whole, F.coalesce(added, F.lit(0.0)) + F.coalesce(seed, F.lit(0.0))).otherwise(F.lit(float("nan"))).alias(f"_add_{p}"))
        keep = (1 - k) ** rows
        reach = 1 if keep < LEAST_WEIGHT else math.ceil(math.log(LEAST_WEIGHT) / math.log(keep))
        before = Window.partitionBy("symbol").orderBy("slice").rowsBetween(-reach, -1)
        chained = F.aggregate(F.collect_list(f"_add_{p}").over(before), F.lit(0.0), _carry(keep))
        broken = F.max(F.isnan(f"_add_{p}")).over(Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        starts.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(float("nan"))).otherwise(chained).alias(f"_start_{p}"))
    chain = cut.groupBy("symbol", "slice").agg(*sums).select("symbol", "slice", *starts)

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        x, rn0 = pc.fill_null(t.column(price).cast(pa.float64()), float("nan")).to_numpy(), t.column("rn")[0].as_py()
        for p in periods:
            k = 2.0 / (p + 1)
            if rn0 == 1:
                found = np.full(len(x), np.nan)
                if len(x) >= p:
                    found[p - 1] = x[:p].sum() / p
                    found[p:] = averages(x[p:], k, found[p - 1])
            else:
                found = averages(x, k, t.column(f"_start_{p}")[0].as_py())
            t = t.append_column(f"ema_{p}", pa.array(found, mask=np.isnan(found)))
        return t.drop_columns(["slice", *(f"_start_{p}" for p in periods)])

    kept = ", ".join(f"`{c}` {t}" for c, t in numbered.dtypes)
    found = cut.join(chain, ["symbol", "slice"]).select(*numbered.columns, "slice", *(f"_start_{p}" for p in periods)).groupBy("symbol", "slice").applyInArrow(fill, kept + ", " + ", ".join(f"ema_{p} double" for p in periods))
    return found if "rn" in bars.columns else found.drop("rn")
