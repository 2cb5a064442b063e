"""Correlation of many symbols: how tiles are sent, and strips that hold several blocks of symbols."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.functions import scalar
from tickforge.operators import compare, correlation


def series_of(seed, symbols, length):
    """Series with gaps and missing values, and two that don't vary."""
    rng = np.random.default_rng(seed)
    found = {f"s{i}": {int(k): (None if rng.random() < 0.1 else 1e3 + float(rng.normal())) for k in np.flatnonzero(rng.random(length) < 0.7) - 5} for i in range(symbols)}
    return found | {"flat": dict.fromkeys(range(20), 1e3 + 0.1), "gone": {k: None for k in range(5)}, "whole": {k: float(k % 7) for k in range(20)}, "far": {length: 1.0}}


def expected(series):
    want = {}
    for a, b in itertools.combinations_with_replacement(sorted(series), 2):
        shared = series[a].keys() & series[b].keys()
        pairs = np.array([(series[a][k], series[b][k]) for k in shared if None not in (series[a][k], series[b][k])])
        if shared:
            want[a, b] = len(shared), np.corrcoef(pairs.T)[0, 1] if len(pairs) > 1 and np.ptp(pairs[:, 0]) > 0 and np.ptp(pairs[:, 1]) > 0 else 0.0
    return want


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("block, positions, alone", [(2, 7, True), (2, 3, False), (1, 64, True)])
def test_strips_equal_single_pairs(spark, monkeypatch, block, positions, alone, both):
    """Two strips of several blocks, in one range of positions or more: each pair once, or once each way."""
    series = series_of(block, 9, 40)
    rows = [(s, k, x) for s, values in series.items() for k, x in values.items()]
    monkeypatch.setattr(correlation, "LEAST_STRIPS", 2)
    monkeypatch.setattr(correlation, "STRIP_VALUES", len(rows))
    assert (-(-(40 + 5 + 1) // (positions * correlation.RANGE_TILES)) == 1) == alone
    got = correlation.correlations(spark.createDataFrame(rows, "symbol string, k int, x double"), len(series), block, positions, (len(rows), -5, 40), both).collect()
    want = expected(series)
    want |= {(b, a): x for (a, b), x in want.items()} if both else {}
    assert len(got) == len(want) and {(r.sym_a, r.sym_b) for r in got} == want.keys()
    for r in got:
        n, c = want[r.sym_a, r.sym_b]
        assert r.n == n and r["corr"] == pytest.approx(c, abs=1e-6), r


def test_what_is_sent(spark):
    """A tile holds just its values, and is sent once a strip, not once a block of symbols; with few values for many symbols there are few strips."""
    symbols, length = 400, 3
    rows = spark.range(symbols * length).select((F.col("id") % symbols).alias("symbol"), F.floor(F.col("id") / symbols).alias("k"), F.rand(1).alias("x"))
    sent = correlation._sent(rows, 100, correlation.LEAST_STRIPS, correlation.BLOCK_POSITIONS)
    size = sent.agg(F.sum(F.length("cells") + F.length("x")).alias("bytes")).first().bytes
    assert size == 12 * symbols * length * correlation.LEAST_STRIPS
    found = correlation.correlations(rows, symbols, 4, extent=(symbols * length, 0, length - 1), both=True)
    assert found.count() == symbols**2


def test_half_away(spark):
    v = [0.0078125, -0.0078125, 0.1234564, -0.1234566, 1.0, -1.0, 0.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in v], "v double").select(scalar.half_away(F.col("v"), 6).alias("v")).collect()]
    assert got == [0.007813, -0.007813, 0.123456, -0.123457, 1.0, -1.0, 0.0]


def test_days_in_two_ranges(spark, monkeypatch):
    """Days a century apart are in two ranges, whose sums are added up by pair; only the days that there are get sent."""
    start = dt.date(1901, 1, 1)
    rng = np.random.default_rng(3)
    days = {s: sorted({int(x) for x in rng.integers(0, 25, 15)} | {45_000 + int(x) for x in rng.integers(0, 25, 15)}) for s in "abcde"}
    price = {(s, d): 10 + float(rng.random()) for s, own in days.items() for d in own}
    rows = [(s, dt.datetime.combine(start + dt.timedelta(days=d), dt.time()), x) for (s, d), x in price.items()]
    bytes_sent, plain = [], correlation._sent

    def sent(*args):
        out = plain(*args)
        bytes_sent.append(out.agg(F.sum(F.length("cells") + F.length("x")).alias("n")).first().n)
        return out

    monkeypatch.setattr(correlation, "_sent", sent)
    got = {(r.sym_a, r.sym_b): r for r in compare.correlation_matrix(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), "date").collect()}
    rets = {s: {d: price[s, d] / price[s, before] - 1 for before, d in itertools.pairwise(own)} for s, own in days.items()}
    assert bytes_sent == [12 * sum(map(len, rets.values()))]
    assert got.keys() == set(itertools.product("abcde", repeat=2))
    for (a, b), r in got.items():
        shared = sorted(rets[a].keys() & rets[b].keys())
        assert r.n == len(shared) > 2 and r["corr"] == pytest.approx(np.corrcoef([rets[a][d] for d in shared], [rets[b][d] for d in shared])[0, 1], abs=1e-9)
