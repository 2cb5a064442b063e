"""Stateful indicators on a stream and refreshes without a rescan: equal to the batch, over restarts and repeated batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import indicators, liquidity
from tickforge.streaming import live, refresh

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def keyed_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, live.PROVIDER)
    yield
    spark.conf.set(key, before)


SCHEMA = "symbol string, ts timestamp, close double"


def rows():
    rng = random.Random(1)
    out = [(s, T0 + dt.timedelta(days=i), None if (s, i) == ("gap", 11) else 20 + 10 * rng.random()) for s, n in (("a", 60), ("b", 7), ("gap", 30)) for i in range(n)]
    return out + [("flat", T0 + dt.timedelta(days=i), 5.0) for i in range(25)]


def test_stream_equals_batch_over_a_restart(spark, tmp_path, keyed_state):
    mine = rows()
    for cut, part in enumerate((mine[:5] + mine[60:70], [], mine[5:20] + mine[70:], mine[20:60], mine[:3])):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        found = live.with_indicators(stream, sma=(3, 5), rsi=4, ema=(2, 6))
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = indicators.positions(spark.createDataFrame(mine, SCHEMA))
    batch = indicators.with_rsi(indicators.with_sma(indicators.with_ema(batch, [2, 6]), [3, 5]), 4)
    crosses = {(r.symbol, r.ts): r.cross for r in indicators.crosses(batch, "sma_3", "sma_5").collect()}
    want = {(r.symbol, r.ts): r for r in batch.collect()}
    assert got.keys() == want.keys() and spark.read.parquet(str(tmp_path / "out")).count() == len(mine)
    for k, r in got.items():
        assert r.rn == want[k].rn and r.cross == crosses.get(k), k
        for c in ("close", "sma_3", "sma_5", "rsi_4", "ema_2", "ema_6"):
            w = want[k][c]
            assert r[c] is None if w is None else r[c] == pytest.approx(w, rel=1e-9), (k, c, r[c], w)
    assert len(crosses) > 3


def ticks(spark, n=900):
    rng = random.Random(2)
    out = [(rng.choice(["purchase", "a", "b"]), T0 + dt.timedelta(hours=rng.randrange(24 * 25)), i, float(rng.randrange(1, 60) * (30 if rng.random() < 0.02 else 1))) for i in range(n)]
    return spark.createDataFrame(out, "symbol string, ts timestamp_ntz, id long, price double").repartition(3)


def batch_history(df):
    days = df.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("volume"), F.max_by("price", F.struct("ts", "id")).alias("close"))
    return liquidity.history(days, "purchase")


def check(spark, path, df):
    want = {r.date: r.total_volume for r in batch_history(df).collect()}
    assert {r.date: r.total_volume for r in refresh.history(spark, path, "purchase").collect()} == pytest.approx(want)
    m = refresh.moments(spark, path).first()
    mean = sum(want.values()) / len(want) if want else 0
    assert (m.n, m.mean) == (len(want), pytest.approx(mean)) and m.m2 == pytest.approx(sum((v - mean) ** 2 for v in want.values()))
    spikes = {r.date: r.deviation for r in refresh.spikes(spark, path, "purchase").collect()}
    assert spikes == pytest.approx({r.date: r.deviation for r in liquidity.spikes(batch_history(df)).collect()})
    return spikes


def test_batches_one_of_them_twice(spark, tmp_path):
    df, path = ticks(spark), str(tmp_path / "kept")
    assert refresh.spikes(spark, path, "purchase").count() == 0 and refresh.moments(spark, path).first().n == 0
    parts = [df.where("ts < '2024-01-11'"), df.where("ts >= '2024-01-09' and id % 2 = 0 and ts >= '2024-01-11'"), df.where("id % 2 = 1 and ts >= '2024-01-11'")]
    refresh.upsert(parts[0], 0, path, "purchase")
    check(spark, path, parts[0])
    for _ in range(2):
        refresh.upsert(parts[1], 1, path, "purchase")
        check(spark, path, parts[0].unionByName(parts[1]))
    refresh.upsert(parts[2], 2, path, "purchase")
    assert check(spark, path, df)
    refresh.upsert(df.limit(0), 3, path, "purchase")
    check(spark, path, df)


def test_days_alike_are_no_spikes(spark, tmp_path):
    rows_ = [("a", T0 + dt.timedelta(days=i, hours=h), 2 * i + h, 0.1) for i in range(14) for h in range(2)]
    df = spark.createDataFrame(rows_, "symbol string, ts timestamp_ntz, id long, price double")
    for k in range(2):
        refresh.upsert(df.where(f"id % 2 = {k}"), k, str(tmp_path), "purchase")
    assert refresh.moments(spark, str(tmp_path)).first().n == 14 and refresh.spikes(spark, str(tmp_path), "purchase", top=None).count() == 0


def test_a_stream_refreshes(spark, tmp_path):
    df = ticks(spark, 300)
    for k in range(2):
        df.where(f"id % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        assert refresh.start(stream, str(tmp_path / "kept"), str(tmp_path / "state"), "purchase", availableNow=True).awaitTermination(120)
    check(spark, str(tmp_path / "kept"), df)
