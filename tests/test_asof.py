"""As-of joins and bars of several widths against plain loops, and what their plans read."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickforge.operators import asof, liquidity, timeframe
from tickforge.plans import catalog

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def matched(rows, others, direction, reach):
    """(key, ts, id, ordinal of the match) by looking at every other row."""
    for key, ts, i in rows:
        near = [(abs(t - ts), o) for k, t, o in others if k == key and k is not None and ts is not None and t is not None and (direction != "before" or t <= ts) and (direction != "after" or t >= ts)]
        d, o = min(near, default=(0, None))
        yield key, at(ts), i, None if reach is not None and d > reach else o


@pytest.mark.parametrize("direction", ["nearest", "before", "after"])
@pytest.mark.parametrize("rows, reach", [(1, None), (3, 40), (7, None), (1 << 16, 5)])
def test_asof(spark, direction, rows, reach):
    rng = random.Random(rows)
    keys = ["hot"] * 6 + ["a", "b", None, "only left"]
    # Half of all rows have the hot key; many share a moment; gaps span slices and days.
    moment = lambda: rng.choice([None, rng.randrange(60), rng.randrange(60), rng.randrange(9) * 100_000])
    left = [(rng.choice(keys), moment(), i) for i in range(150)]
    right = [(rng.choice(keys[:-1]), moment(), o) for o in rng.sample(range(1000), 60)]
    df = spark.createDataFrame([(k, at(t), i, 1, "x") for k, t, i in left], "key string, ts timestamp_ntz, id int, ordinal int, slice string").repartition(5)
    other = spark.createDataFrame([(k, at(t), o, 2) for k, t, o in right], "key string, ts timestamp_ntz, ordinal int, id int").repartition(3)
    got = asof.join_asof(df, other, ["key"], direction=direction, reach_seconds=reach, rows=rows)
    assert got.columns == [*df.columns, "match"]
    want = Counter(matched(left, right, direction, reach))
    assert Counter((r.key, r.ts, r.id, r.match and r.match.ordinal) for r in got.collect()) == want
    assert asof.join_asof(df, other.limit(0), ["key"]).where("match is not null").count() == 0
    assert asof.join_asof(df.limit(0), other, ["key"]).count() == 0


def test_asof_keys_and_errors(spark):
    left = spark.createDataFrame([(1, "x", at(5)), (1, "y", at(5)), (2, None, at(5))], "a int, b string, ts timestamp_ntz")
    right = spark.createDataFrame([(1, "x", at(9), 1), (1, "y", at(1), 2)], "a int, b string, ts timestamp_ntz, ordinal int")
    got = {(r.a, r.b): r.match and r.match.ordinal for r in asof.join_asof(left, right, ["a", "b"]).collect()}
    assert got == {(1, "x"): 1, (1, "y"): 2, (2, None): None}
    with pytest.raises(ValueError):
        asof.join_asof(left, right, ["a"], direction="sideways")


def ticks(spark, n=400):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randrange(86400 * 40)), i, float(rng.randrange(100))) for i in range(n)]
    return spark.createDataFrame(rows + [("a", rows[0][1], n, 7.0)], "symbol string, ts timestamp_ntz, id long, price double").repartition(4)


COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "n"]


def test_all_widths_equal_each_width(spark):
    df = ticks(spark)
    got = timeframe.resample_all(df, list(timeframe.WIDTHS))
    for w in timeframe.WIDTHS:
        one = timeframe.resample(df, w).select(COLUMNS)
        assert Counter(got.where(F.col("width") == w).select(COLUMNS).collect()) == Counter(one.collect()), w
    weighed = df.withColumn("volume", F.col("price") + 1)
    assert Counter(timeframe.resample_all(weighed, ["1d"]).select(COLUMNS).collect()) == Counter(timeframe.resample(weighed, "1d").select(COLUMNS).collect())


@pytest.mark.parametrize("as_of", ["2024-04-01", "2024-04-03 10:33:21.5"])
def test_ranges_equal_each_range(spark, as_of):
    """Also where a range starts within a bar."""
    df = ticks(spark, 3000)
    asked = [("1D", None), ("1W", None), ("1M", None), ("5Y", None), ("ALL", None), ("1D", "1h"), ("1W", "1m")]
    got = timeframe.bars_for_ranges(df, asked, as_of)
    total = 0
    for name, interval in asked:
        width = timeframe.interval_for(name, interval)
        one = timeframe.bars_for_range(df, name, as_of, interval).select(COLUMNS).collect()
        assert Counter(got.where((F.col("range") == name) & (F.col("width") == width)).select(COLUMNS).collect()) == Counter(one), name
        total += len(one)
    assert got.count() == total
    days = df.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("volume"), F.max_by("price", F.struct("ts", "id")).alias("close"))
    found = liquidity.history_for_ranges(days, ["1W", "1Y", "5Y", "ALL"], as_of, "a")
    for name in ("1W", "1Y", "5Y", "ALL"):
        one = {r.date: r.total_volume for r in liquidity.history_for_range(days, name, as_of, "a").collect()}
        assert {r.date: r.total_volume for r in found.where(F.col("range") == name).collect()} == pytest.approx(one)


def plan(spark, d, name):
    return catalog.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_one_scan(spark, sf_dir):
    for name, exchanges in (("bars_all_widths", 2), ("bars_by_range", 2), ("history_by_range", 3)):
        found = plan(spark, sf_dir, name)
        assert found.count("FileScan") == 1 and found.count("Exchange") == exchanges, name
    for name in ("bars_by_range", "price_chart"):
        assert "GreaterThanOrEqual(ts,2024-" in plan(spark, sf_dir, name) or "GreaterThanOrEqual(ts,2019-" in plan(spark, sf_dir, name), name
    assert "EqualTo(event_type,purchase)" in plan(spark, sf_dir, "futures_price")
    assert "SinglePartition" not in plan(spark, sf_dir, "nearest_purchase")


def test_many_spikes_are_numbered(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=37 * i),) for i in range(60)], "date date").repartition(4)
    got = liquidity.numbered(days).orderBy("date").collect()
    assert [r.number for r in got] == list(range(1, 61)) and liquidity.numbered(days).columns == ["date", "number"]
