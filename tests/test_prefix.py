"""Sliding sums from prefix sums: against exact sums, over slices, and their error."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tickforge.operators import indicators, prefix


def bars(spark, **series):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), None if v is None else float(v), "x") for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, slice_ string").repartition(4)


def test_running_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000) * 10.0 ** rng.integers(-8, 16, 4000)
    high, low = prefix.running(x)
    for i in range(0, 4000, 97):
        exact = math.fsum(x[: i + 1])
        assert abs((high[i] + low[i]) - exact) <= 2**-52 * abs(exact) + i * i * 2.0**-104 * math.fsum(np.abs(x[: i + 1]))
        assert math.fsum([high[i], low[i], -exact]) == pytest.approx(0, abs=i * i * 2.0**-100 * np.abs(x).sum() + abs(exact) * 2**-52)


@pytest.mark.parametrize("rows", [4, 7, 64, 1 << 16])
def test_windows_of_any_length(spark, rows):
    """Sums of small numbers after very large ones, gaps, series of other lengths, windows shorter and longer than a slice."""
    rng = random.Random(rows)
    series = {"big": [1e16, -3.0, 1e15] + [rng.random() for _ in range(90)], "gaps": [None if rng.random() < 0.3 else rng.gauss(0, 9) for _ in range(70)], "one": [5.0], "zeros": [7.0] + [0.0] * 40}
    numbered = indicators.positions(bars(spark, **series))
    periods = [1, 3, 10, 33]
    got = {(r.symbol, r.rn): r for r in prefix.window_sums(numbered, ["close"], periods, rows).collect()}
    assert len(got) == sum(map(len, series.values()))
    for s, x in series.items():
        for i in range(len(x)):
            for p in periods:
                total, n = got[s, i + 1][f"close_sum_{p}"], got[s, i + 1][f"close_n_{p}"]
                if i + 1 < p:
                    assert total is None and n is None
                    continue
                known = [v for v in x[i + 1 - p : i + 1] if v is not None]
                exact = math.fsum(known)
                bound = 2**-52 * abs(exact) + len(x) ** 2 * 2.0**-104 * math.fsum(abs(v) for v in x[: i + 1] if v is not None)
                assert n == len(known) and abs(total - exact) <= bound, (s, i, p)
    assert all(got["zeros", i][f"close_sum_{p}"] == 0.0 for p in periods for i in range(p + 1, 42))


def test_same_as_windows(spark):
    rng = random.Random(3)
    df = bars(spark, a=[rng.random() * 50 for _ in range(120)], b=[5.0] * 40, c=[3.0] * 20 + [rng.random() for _ in range(30)])
    for rows in (5, 1000):
        mine, theirs = prefix.with_rsi(prefix.with_sma(df, [4, 30], rows=rows), 14, rows=rows), indicators.with_rsi(indicators.with_sma(df, [4, 30]), 14)
        assert mine.columns == theirs.columns
        want = {(r.symbol, r.ts): r for r in theirs.collect()}
        for r in mine.collect():
            for c in ("sma_4", "sma_30", "rsi_14"):
                w = want[r.symbol, r.ts][c]
                assert (r[c] is None) == (w is None) and (w is None or r[c] == pytest.approx(w, rel=1e-9)), (r, c)
            assert r.slice_ == "x"
    assert prefix.with_sma(df.limit(0), [3]).count() == 0

