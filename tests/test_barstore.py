"""The bar store: equal to indicators on bars, read without shuffles, pruned by time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import indicators
from tickforge.sources import barstore


def bars(spark, n=300, gap=None):
    rng = random.Random(6)
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=3 * i), None if (s, i) == gap else 50 + rng.random() * 20, float(i), i % 7) for s, k in (("a", n), ("b", n // 3), ("c", 5)) for i in range(k)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume double, year_ int").repartition(5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, gap", [(64, None), (100, ("a", 130)), (1000, ("a", 2))])
def test_indicators_from_the_store(spark, rows, gap):
    df = bars(spark, gap=gap)
    name = barstore.write(df, rows=rows, lookback=64, buckets=3)
    got = barstore.with_indicators(spark, name, sma=[3, 20], rsi=[5], ema=[2])
    assert "Exchange" not in plan(got) and got.columns == [*df.columns, "sma_3", "sma_20", "rsi_5", "ema_2"]
    numbered = indicators.positions(df)
    want = indicators.with_rsi(indicators.with_sma(indicators.with_ema(numbered, [2]), [3, 20]), 5)
    rows_of = lambda x: {(r.symbol, r.ts): r for r in x.collect()}
    mine, theirs = rows_of(got), rows_of(want)
    assert mine.keys() == theirs.keys()
    for k, r in mine.items():
        for c in ("close", "volume", "ema_2", "sma_3", "sma_20", "rsi_5"):
            assert r[c] == (None if theirs[k][c] is None else pytest.approx(theirs[k][c], rel=1e-12)), (k, c)
    barstore.drop(spark, name)
    assert not spark.catalog.tableExists(name)


def test_every_bar_once_and_ranges(spark):
    df = bars(spark, 500)
    name = barstore.write(df, rows=50, lookback=20)
    assert sorted(barstore.bars(spark, name).collect()) == sorted(df.collect())
    found = barstore.in_range(spark, name, "1M", "2021-02-01")
    want = df.where("ts between timestamp_ntz'2021-02-01' - interval 30 days and timestamp_ntz'2021-02-01'")
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 5
    shown = plan(found)
    assert "year" in shown.split("PartitionFilters")[1][:200] and "Exchange" not in shown and "GreaterThanOrEqual(ts" in shown
    years = {f.split("year=")[1][:4] for f in found.inputFiles()}
    assert years == {"2021"}
    assert sorted(barstore.between_days(spark, name, "2020-12-30", "2021-01-04").collect()) == sorted(df.where("ts between timestamp_ntz'2020-12-30' and timestamp_ntz'2021-01-04'").collect())


def test_limits(spark):
    df = bars(spark, 20)
    name = barstore.write(df, rows=50, lookback=10)
    assert barstore.lookback(spark, name) == 10
    with pytest.raises(ValueError):
        barstore.with_indicators(spark, name, sma=[12])
    with pytest.raises(ValueError):
        barstore.with_indicators(spark, name, ema=[12])
    with pytest.raises(ValueError):
        barstore.write(df, rows=5, lookback=10)
    empty = barstore.write(df.where(F.lit(False)), rows=50, lookback=10)
    assert barstore.with_indicators(spark, empty, sma=[3], ema=[1]).count() == 0
