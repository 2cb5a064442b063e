"""Sums over sliding windows of any length, from prefix sums in two doubles.

A window's sum is the prefix sum at its end less that before its start: two look-ups, however long the window. Each slice of a series adds up its
own rows, sums of slices are chained by one row a slice, and each row's prefix is sent once for each period to the slice in which it is
needed. No row is copied to the slices after it, and a window may span many slices.

A prefix is a double and the sum of all its rounding errors, which are exact, so it is as good as a sum in twice the precision. With n
rows so far, a window's sum is off by at most 2^-52 of itself and n^2 * 2^-104 of the sum of absolute values so far. A window of zeros sums up to
exactly 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators


def two_sum(a, b):
    """a + b in double precision, and what rounding took off."""
    s = a + b
    bb = s - a
    return s, (a - (s - bb)) + (b - bb)


def added(h, l, k, m):
    """(h + l) + (k + m) as two doubles."""
    s, e = two_sum(h, k)
    return two_sum(s, e + (l + m))


def running(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of x as two doubles."""
    high = np.cumsum(x)
    lost = np.zeros(len(x))
    if len(x) > 1:
        _, lost[1:] = two_sum(high[:-1], x[1:])
    return two_sum(high, np.cumsum(lost))


def _names(c: str) -> list[str]:
    return [f"_{c}_high", f"_{c}_low", f"_{c}_n"]


def window_sums(numbered: DataFrame, columns: list[str], periods: list[int], rows: int = indicators.SLICE_ROWS) -> DataFrame:
    """numbered (symbol, rn, ...) and, for each column and period, <column>_sum_<period> and <column>_n_<period>: sum and number of the known values among the last `period` rows; null for the first period - 1 rows."""
    kinds = dict(numbered.dtypes)
    fields = [n for c in columns for n in _names(c)]
    typed = ", ".join(f"`{n}` {'long' if n.endswith('_n') else 'double'}" for n in fields)
    cut = numbered.withColumn("slice", F.floor((F.col("rn") - 1) / rows).cast("long"))

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        for c in columns:
            x = pc.fill_null(t.column(c).cast(pa.float64()), float("nan")).to_numpy()
            known = ~np.isnan(x)
            for name, values in zip(_names(c), (*running(np.where(known, x, 0.0)), np.cumsum(known))):
                t = t.append_column(name, pa.array(values))
        return t

    plain = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes)
    local = cut.groupBy("symbol", "slice").applyInArrow(scan, f"{plain}, {typed}")

    def chain(batches):
        symbol, known, sums = None, False, None
        for b in batches:
            out = []
            for row in zip(*(col.to_pylist() for col in b.columns)):
                if not known or row[0] != symbol:
                    symbol, known, sums = row[0], True, [0] * len(fields)
                out.append((row[0], row[1], *sums))
                now = []
                for k in range(0, len(fields), 3):
                    now += [*added(sums[k], sums[k + 1], row[2 + k], row[3 + k]), sums[k + 2] + row[4 + k]]
                sums = now
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(b.schema)], names=["symbol", "slice", *(f"c{n}" for n in fields)])

    ends = local.groupBy("symbol", "slice").agg(F.max_by(F.struct(*fields), "rn").alias("e")).select("symbol", "slice", *(F.col(f"e.{n}").alias(n) for n in fields))
    carried = ends.repartition("symbol").sortWithinPartitions("symbol", "slice").mapInArrow(chain, f"symbol {kinds['symbol']}, slice long, " + ", ".join(f"`c{n}` {'long' if n.endswith('_n') else 'double'}" for n in fields))
    started = local.join(carried, ["symbol", "slice"])
    # A row goes to its own slice, and for each period its sums go to where the row `period` further on is.
    own, rest = F.lit(0).alias("p"), [c for c in numbered.columns if c not in ("symbol", "rn")]
    targets = F.array(F.struct(own, F.col("rn").alias("to")), *(F.struct(F.lit(p).alias("p"), (F.col("rn") + p).alias("to")) for p in periods))
    sums = [*fields, *(f"c{n}" for n in fields)]
    sent = started.select("symbol", F.struct(*rest).alias("_row"), *sums, F.explode(targets).alias("t"))
    sent = sent.select("symbol", F.col("t.to").alias("rn"), F.col("t.p").alias("_p"), F.when(F.col("t.p") == 0, F.col("_row")).alias("_row"), *sums, F.floor((F.col("t.to") - 1) / rows).cast("long").alias("_slice"))

    def look_up(t: pa.Table) -> pa.Table:
        p = t.column("_p").to_numpy()
        mine = t.filter(pa.array(p == 0)).sort_by("rn")
        if not mine.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema(t)})
        rn = mine.column("rn").to_numpy()
        found = {f.name: mine.column(f.name) for f in t.schema if f.name in ("symbol", "rn", "_row")}

        def prefix(part: pa.Table, c: str):
            h, l, n, ch, cl, cn = (part.column(x).to_numpy() for x in [*_names(c), *(f"c{x}" for x in _names(c))])
            return *added(ch, cl, h, l), n + cn

        earlier = {q: t.filter(pa.array(p == q)) for q in periods}
        for c in columns:
            h, l, n = prefix(mine, c)
            for q in periods:
                before = earlier[q]
                at = np.searchsorted(rn, before.column("rn").to_numpy())
                keep = at < len(rn)
                keep[keep] = rn[at[keep]] == before.column("rn").to_numpy()[keep]
                bh, bl, bn = np.zeros(len(rn)), np.zeros(len(rn)), np.zeros(len(rn), np.int64)
                for to, values in zip((bh, bl, bn), prefix(before, c)):
                    to[at[keep]] = values[keep]
                total = np.add(*added(h, l, -bh, -bl))
                short = rn < q
                found[f"{c}_sum_{q}"], found[f"{c}_n_{q}"] = pa.array(total, mask=short), pa.array(n - bn, mask=short)
        return pa.table(found)

    counts = {f"{c}_{k}_{q}": k == "n" for c in columns for q in periods for k in ("sum", "n")}
    results = list(counts)

    def out_schema(t: pa.Table) -> list[pa.Field]:
        kept = [f for f in t.schema if f.name in ("symbol", "rn", "_row")]
        return kept + [pa.field(n, pa.int64() if counts[n] else pa.float64()) for n in results]

    row_kind = dict(sent.dtypes)["_row"]
    schema = f"symbol {kinds['symbol']}, rn {kinds['rn']}, _row {row_kind}, " + ", ".join(f"`{n}` {'long' if counts[n] else 'double'}" for n in results)
    found = sent.select("symbol", "rn", "_row", "_p", "_slice", *sums).groupBy("symbol", "_slice").applyInArrow(look_up, schema)
    return found.select("symbol", "rn", "_row.*", *results).select(*numbered.columns, *results)


def mean_of(c: str, period: int) -> Column:
    return F.try_divide(F.col(f"{c}_sum_{period}"), F.col(f"{c}_n_{period}").cast("double"))


def with_sma(bars: DataFrame, periods: list[int], price: str = "close", ts: str = "ts", rows: int = indicators.SLICE_ROWS) -> DataFrame:
    """sma_<period> as indicators.with_sma, for periods of any length."""
    numbered = (bars if "rn" in bars.columns else indicators.positions(bars, ts)).withColumn("_x", F.col(price).cast("double"))
    found = window_sums(numbered, ["_x"], periods, rows)
    return found.select(*bars.columns, *(mean_of("_x", p).alias(f"sma_{p}") for p in periods))


def with_rsi(bars: DataFrame, period: int, price: str = "close", ts: str = "ts", rows: int = indicators.SLICE_ROWS) -> DataFrame:
    """rsi_<period> as indicators.with_rsi, for periods of any length."""
    numbered = bars if "rn" in bars.columns else indicators.positions(bars, ts)
    changed = indicators.in_slices(numbered, 1, lambda cut: cut.withColumn("_c", F.col(price) - F.lag(price).over(indicators.by_slice(ts))), ts, rows)
    moved = changed.withColumns({"_up": F.greatest("_c", F.lit(0.0)), "_down": F.greatest(-F.col("_c"), F.lit(0.0))}).drop("_c")
    found = window_sums(moved, ["_up", "_down"], [period], rows)
    gain, loss = F.col(f"_up_sum_{period}"), F.col(f"_down_sum_{period}")
    rsi = F.when(F.col("rn") <= period, None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return found.select(*bars.columns, rsi.alias(f"rsi_{period}"))
