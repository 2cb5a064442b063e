import datetime as dt
import re

from tickforge.streaming import streams


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_bars_from_a_stream(spark, tmp_path):
    rows = [("a", at(1), 1, 5.0), ("a", at(30), 2, 9.0), ("a", at(59), 3, 7.0), ("a", at(61), 4, 1.0)]
    df = streams.stream_bars(source(spark, tmp_path, rows, "symbol string, ts timestamp, id long, price double"))
    got = run(df, "complete", "bars").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(5, 9, 5, 7, 3), (1, 1, 1, 1, 1)]


def test_limits_in_a_stream(spark, tmp_path):
    rows = [("c", at(i)) for i in range(5)] + [("c", at(70))]
    df = streams.rate_limits(source(spark, tmp_path, rows, "client string, ts timestamp"), limit=3)
    got = run(df, "complete", "limits").orderBy("ts").collect()
    assert [(r.n, r.allowed, r.rejected) for r in got] == [(5, 3, 2), (1, 1, 0)]


def test_cached_lookups(spark, tmp_path):
    rows = [("k", at(0)), ("k", at(10)), ("k", at(31)), ("j", at(5))]
    df = streams.cached_lookups(source(spark, tmp_path, rows, "key string, ts timestamp"), 30)
    got = {(r.key, (r.ts - at(0)).seconds): r.hit for r in run(df, "append", "lookups").collect()}
    assert got == {("k", 0): False, ("k", 10): True, ("k", 31): False, ("j", 5): False}


def test_lookup_hits(spark):
    """Batch look-ups against a walk through each key's requests."""
    rng = __import__("random").Random(2)
    rows = [(rng.choice("aab"), at(rng.randrange(3000)), i) for i in range(400)]
    want, last = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        hit = key in last and (ts - last[key]).total_seconds() < 30
        if not hit:
            last[key] = ts
        want[i] = hit
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long").repartition(5)
    got = {r.id: (r.hit, r.key) for r in streams.lookup_hits(df, 30).collect()}
    assert {i: h for i, (h, _) in got.items()} == want and {i: k for i, (_, k) in got.items()} == {i: k for k, _, i in rows}
    assert streams.lookup_hits(df.limit(0), 30).count() == 0


def test_plans(spark, sf_dir):
    """Windows are by symbol, filters reach the scan, fixed tables are broadcast."""
    from tickforge.operators import indicators, timeframe
    from tickforge.plans import catalog
    from tickforge.sources import adapters

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    found = plan(indicators.with_rsi(indicators.with_sma(adapters.daily_bars(spark, sf_dir), [50, 200])))
    assert "SinglePartition" not in found
    for name in ("sma_50_200", "rsi_14", "daily_changes", "daily_returns", "ma_crosses", "signal_report", "ma_panel", "rsi_zone", "running_peak", "ema_12_26"):
        assert re.search(r"hashpartitioning\(symbol#\d+, slice#", plan(catalog.queries()[name](spark, sf_dir))), name
    scan = plan(timeframe.in_range(adapters.table(spark, sf_dir, "events").select("ts", "value"), "1W", "2024-01-31"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in scan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in scan
    assert "Broadcast" in plan(catalog.queries()["nearest_events"](spark, sf_dir))
