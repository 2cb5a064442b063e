"""Summaries of series that merge in order: highest, lowest and last value, worst fall from a peak, and moments of returns.

A slice of a series has one summary. Summaries of slices that follow one another merge into that of both: the worst fall of two slices is
the worse of their own or the fall from the first's peak to the second's low, and the step between them is one more return. So a
series is cut wherever it suits, its slices are summed up by different tasks in one pass, and a row a slice is folded in order: no
window over rows, nothing joined back.

Missing values are left out of all but returns, where they leave a gap on both sides, as does a price of 0 before. A fall from a peak that
isn't positive is none. Values are prices or worths: below 0, a fall may be told too large, as a low is held against the highest peak before its slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n rows, first and last value, peak and low, the worst fall in percent, and number, mean and squared distances of returns.
FIELDS = "n long, first double, last double, peak double, low double, worst double, rets long, mean double, m2 double"
STRUCT = f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
EMPTY = (0, None, None, None, None, 0.0, 0, 0.0, 0.0)


def of(x: np.ndarray) -> tuple:
    """FIELDS of a slice's values in order; nan is missing."""
    known = x[~np.isnan(x)]
    edge = lambda v: None if np.isnan(v) else float(v)
    if not len(x):
        return EMPTY
    peaks = np.maximum.accumulate(known)
    falls = (peaks - known)[peaks > 0] / peaks[peaks > 0] * 100
    before = x[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        rets = (np.diff(x) / before)[(before != 0) & ~np.isnan(before) & ~np.isnan(x[1:])]
    mean = float(rets.mean()) if len(rets) else 0.0
    top, low = (float(known.max()), float(known.min())) if len(known) else (None, None)
    return len(x), edge(x[0]), edge(x[-1]), top, low, float(falls.max(initial=0.0)), len(rets), mean, float(((rets - mean) ** 2).sum())


def then(a: tuple, b: tuple) -> tuple:
    """The FIELDS of a slice and the one after it, in tasks; as merge."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, first, last, peak, low, worst, rets, mean, m2 = a
    step = [(b[1] - last) / last] if last and b[1] is not None else []
    for k, other, more in ((len(step), *step, 0.0) if step else (0, 0.0, 0.0), b[6:]):
        total, d = rets + k, other - mean
        if k:
            mean, m2, rets = mean + d * k / total, m2 + more + d * d * rets * k / total, total
    fall = (peak - b[4]) / peak * 100 if peak is not None and peak > 0 and b[4] is not None else 0.0
    known = lambda pick, *x: pick([v for v in x if v is not None], default=None)
    return n + b[0], first, b[2], known(max, peak, b[3]), known(min, low, b[4]), max(worst, b[5], fall), rets, mean, m2


def _joined(n: Column, mean: Column, m2: Column, k: Column, other: Column, more: Column) -> tuple[Column, Column, Column]:
    """Number, mean and squared distances of two sets of returns."""
    total = n + k
    d = other - mean
    share = F.coalesce(F.try_divide(k, total), F.lit(0.0))
    return total, mean + d * share, m2 + more + d * d * n * share


def merge(a: Column, b: Column) -> Column:
    """The summary of a slice and the one after it."""
    from_peak = F.when(a["peak"] > 0, F.try_divide(a["peak"] - b["low"], a["peak"]) * 100)
    step = F.try_divide(b["first"] - a["last"], a["last"])
    one = step.isNotNull().cast("long")
    rets, mean, m2 = _joined(a["rets"], a["mean"], a["m2"], one, F.coalesce(step, F.lit(0.0)), F.lit(0.0))
    rets, mean, m2 = _joined(rets, mean, m2, b["rets"], b["mean"], b["m2"])
    first = F.when(a["n"] == 0, b["first"]).otherwise(a["first"])
    last = F.when(b["n"] == 0, a["last"]).otherwise(b["last"])
    fields = [a["n"] + b["n"], first, last, F.greatest(a["peak"], b["peak"]), F.least(a["low"], b["low"]), F.greatest(a["worst"], b["worst"], from_peak), rets, mean, m2]
    return F.struct(*(c.alias(name) for c, name in zip(fields, _NAMES))).cast(STRUCT)


def folded(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, s): slices (by, order, s) of each series merged in order; a list has a row for each slice of a series."""
    none = F.struct(F.lit(0).alias("n"), *(F.lit(None).alias(c) for c in _NAMES[1:5]), F.lit(0.0).alias("worst"), F.lit(0).alias("rets"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(STRUCT)
    listed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "s"))).alias("_parts"))
    return listed.select(*by, F.aggregate("_parts", none, lambda a, p: merge(a, p["s"])).alias("s"))


def _sums(rows: list[tuple]) -> pa.StructArray:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[f.split()[1]]) for k, f in enumerate(FIELDS.split(", "))], names=_NAMES)


def by_chunk(chunks: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """(keys, s): the summary of each row's array of values."""

    def work(batches):
        for b in batches:
            found = [of(np.array(x.as_py() or [], np.float64)) for x in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], _sums(found)], names=[*keys, "s"])

    kinds = dict(chunks.dtypes)
    return chunks.select(*keys, values).mapInArrow(work, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", s {STRUCT}")


def by_series(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, s) of rows: dealt by ranges of (by, order), so that a long series is cut over tasks. Each makes one row of its stretch of a series, in one pass."""
    kinds = dict(rows.dtypes)
    width = len(by)

    def work(batches):
        key, sums, part, types = None, EMPTY, 0, []

        def sent(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in found], types[i]) for i in range(width)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(found), pa.int32()), _sums([s for _, s in found])], names=[*by, "_part", "s"])

        for b in batches:
            n, found, types = b.num_rows, [], [b.column(i).type for i in range(width)]
            if not n:
                continue
            part = b.column(width + 1)[0].as_py()
            x = b.column(width).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
            new = np.zeros(n, bool)
            for i in range(width):
                codes = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            for s, e in zip(starts, [*starts[1:], n]):
                mine = tuple(b.column(i)[s].as_py() for i in range(width))
                if mine != key and sums[0]:
                    found.append((key, sums))
                    sums = EMPTY
                key, sums = mine, then(sums, of(x[s:e]))
            if found:
                yield sent(found)
        if sums[0]:
            yield sent([(key, sums)])

    dealt = rows.select(*by, F.col(value).alias("_x"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [*by, *(f"_o{i}" for i in range(len(order)))]
    ranged = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*by, "_x", F.spark_partition_id().alias("_p"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", _part int, s {STRUCT}"
    return folded(ranged.mapInArrow(work, schema), by, "_part")


def worst_fall(s: Column) -> Column:
    return F.greatest(F.lit(0.0), s["worst"])


def deviation(s: Column) -> Column:
    """Sample deviation of returns, 0 for fewer than two."""
    return F.when(s["rets"] < 2, 0.0).otherwise(F.sqrt(F.try_divide(s["m2"], s["rets"] - 1)))

