"""Values worked out by hand, and edge cases."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.functions import scalar
from tickforge.operators import backtest, compare, correlation, indicators, liquidity, portfolio, signals, summary, timeframe
from tickforge.sources import dims, readers

X = [10.0, 11, 12, 11, 10, 9, 10, 12, 14, 13]


def bars(spark, **series):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def column(df, name, order="ts"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g is None if w is None else g == pytest.approx(w, abs=1e-6)


def test_sma(spark):
    df = indicators.with_sma(bars(spark, s=X), [3, 5])
    near(column(df, "sma_3"), [None, None, 11, 11.333333, 11, 10, 9.666667, 10.333333, 12, 13])
    near(column(df, "sma_5"), [None] * 4 + [10.8, 10.6, 10.4, 10.4, 11, 11.6])


@pytest.mark.parametrize("rows", [3, 4, 7, 100])
def test_ema_and_slices(spark, rows):
    df = indicators.with_ema(bars(spark, s=X, t=X[:2], u=X[::-1]), [3], rows=rows)
    near(column(df.where("symbol = 's'"), "ema_3"), [None, None, 11, 11, 10.5, 9.75, 9.875, 10.9375, 12.46875, 12.734375])
    near(column(df.where("symbol = 't'"), "ema_3"), [None, None])
    last = {r.symbol: r.ema for r in indicators.latest_ema(bars(spark, s=X, t=X[:2]), 3).collect()}
    assert last["t"] is None and last["s"] == pytest.approx(12.734375)
    cut = indicators.sliced(indicators.positions(bars(spark, s=X, u=X[::-1])), 4, rows)
    sma = indicators.with_sma(cut, [5]).where("not extra")
    near(column(sma.where("symbol = 's'"), "sma_5"), [None] * 4 + [10.8, 10.6, 10.4, 10.4, 11, 11.6])


def test_rsi(spark):
    near(column(indicators.with_rsi(bars(spark, s=X), 3), "rsi_3"), [None, None, None, 66.666667, 33.333333, 0, 33.333333, 75, 100, 80])
    near(column(indicators.with_rsi(bars(spark, s=[5] * 6), 3), "rsi_3"), [None, None, None, 100, 100, 100])


def test_crosses(spark):
    df = indicators.with_sma(indicators.positions(bars(spark, s=X)), [3, 5])
    found = indicators.crosses(df, "sma_3", "sma_5").orderBy("ts").collect()
    assert [(r.rn - 1, r.cross) for r in found] == [(5, "death_cross"), (8, "golden_cross")]
    assert indicators.recent_cross(indicators.crosses(df, "sma_3", "sma_5")).first().cross == "golden_cross"


def test_returns_and_risk(spark):
    rets = indicators.with_returns(bars(spark, s=X))
    near(column(rets.where("ret is not null"), "ret"), [0.1, 0.090909, -0.083333, -0.090909, -0.1, 0.111111, 0.2, 0.166667, -0.071429])
    one = rets.agg(portfolio.volatility(F.col("ret")).alias("v"), portfolio.sharpe(F.col("ret")).alias("s")).first()
    near([one.v, one.s], [192.0631912120916, 4.683065186869699])
    single = indicators.with_returns(bars(spark, s=[1, 2])).agg(portfolio.volatility(F.col("ret")).alias("v"), portfolio.sharpe(F.col("ret")).alias("s")).first()
    assert (single.v, single.s) == (0.0, 0.0)
    assert portfolio.max_drawdown(bars(spark, s=X), ["symbol"], "ts", "close").first().max_drawdown == pytest.approx(25.0)
    assert spark.range(1).select(portfolio.cagr(F.lit(10.0), F.lit(13.0), F.lit(2.0)).alias("c")).first().c == pytest.approx(14.017542509913806)
    assert spark.range(1).select(portfolio.cagr(F.lit(0.0), F.lit(13.0), F.lit(2.0)).alias("c")).first().c == 0
    assert column(indicators.with_returns(bars(spark, s=[0, 1])), "ret") == [None, None]


def test_correlation(spark):
    m = {(r.sym_a, r.sym_b): (r.n, r["corr"]) for r in compare.correlation_matrix(bars(spark, s=X, t=X[:5])).collect()}
    assert len(m) == 4 and m["s", "t"][0] == 4 and m["s", "s"][1] == pytest.approx(1) and m["s", "t"] == m["t", "s"]
    assert compare.correlation_matrix(bars(spark, s=X)).count() == 0 and compare.correlation_matrix(bars(spark)).count() == 0
    a = [0.1, 1 / 11, -1 / 12, -1 / 11, -0.1, 1 / 9, 0.2]
    b = [0.01, -0.02, 0.03, 0.01, 0, 0.02, -0.01, 5, 6]
    flat, steps = [1.0, 1.0, 1.0], [1.0, 2.0, 3.0]
    rows = [(s, k, float(x)) for s, values in (("a", a), ("b", b), ("c", flat), ("d", steps)) for k, x in enumerate(values)]
    got = {(r.sym_a, r.sym_b): (r.n, r["corr"]) for r in correlation.correlations(spark.createDataFrame(rows, "symbol string, k int, x double"), 4).collect()}
    assert got["a", "b"][0] == 7 and got["a", "b"][1] == pytest.approx(-0.42404673768518686) and got["c", "d"] == (3, 0.0) and got["c", "c"] == (3, 0.0)


@pytest.mark.parametrize("block, positions", [(1, 3), (2, 5), (3, 64), (100, 7)])
def test_correlation_tiles(spark, block, positions):
    """Any cut into tiles gives what every pair of series gives on its own; values may lie far from 0, be missing, or not be there."""
    rng = np.random.default_rng(block)
    series = {f"s{i}": {int(k): (None if rng.random() < 0.1 else 1e3 + float(rng.normal())) for k in np.flatnonzero(rng.random(40) < 0.7) - 5} for i in range(7)}
    series |= {"flat": dict.fromkeys(range(30), 1e3 + 0.1), "far": {100: 1.0}, "gone": {k: None for k in range(5)}}
    df = spark.createDataFrame([(s, k, x) for s, values in series.items() for k, x in values.items()] + [(None, 1, 1.0)], "symbol string, k long, x double")
    got = {(r.sym_a, r.sym_b): (r.n, r["corr"]) for r in correlation.correlations(df, len(series), block, positions).collect()}
    want = {}
    for a, b in itertools.combinations_with_replacement(sorted(series), 2):
        shared = series[a].keys() & series[b].keys()
        pairs = np.array([(series[a][k], series[b][k]) for k in shared if None not in (series[a][k], series[b][k])])
        if shared:
            varies = len(pairs) > 1 and np.ptp(pairs[:, 0]) > 0 and np.ptp(pairs[:, 1]) > 0
            want[a, b] = len(shared), np.corrcoef(pairs.T)[0, 1] if varies else 0.0
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(c, abs=1e-6), k


def days(spark, values):
    return spark.createDataFrame([(dt.date(2024, 5, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "date date, total_volume double")


def test_spikes(spark):
    v = [100, 102, 98, 101, 99, 100, 103, 97, 180, 100, 150, 99]
    got = [((r.date - dt.date(2024, 5, 1)).days, round(r.deviation, 6)) for r in liquidity.spikes(days(spark, v)).collect()]
    assert got == [(8, 2.762231), (10, 1.565596)]
    assert liquidity.spikes(days(spark, v[:9])).count() == 0
    assert liquidity.spikes(days(spark, [5] * 12)).count() == 0


def test_nearest_event(spark):
    asked = [(dt.date(2024, 2, 1),), (dt.date(2024, 3, 10),), (dt.date(2024, 4, 18),), (dt.date(2024, 4, 19),)]
    got = [r.event_date for r in liquidity.nearest_event(spark.createDataFrame(asked, "date date")).orderBy("date").collect()]
    assert got == [dt.date(2024, 1, 31), dt.date(2024, 3, 12), dt.date(2024, 4, 15), None]


def test_simulation(spark):
    df = bars(spark, A=[100, 110, 121, 130], B=[50, 45, 55])
    got = portfolio.simulate(df, {"A": 50, "B": 50}, 10000.0, "2024-01-01", "2024-12-31")
    near(column(got, "value", "i"), [10000, 10000, 11550])
    assert portfolio.simulate(bars(spark, A=[1, 2], B=[1]), {"A": 50, "B": 50}, 1.0, "2024-01-01", "2024-12-31").count() == 0
    assert portfolio.simulate(bars(spark, A=[1, 2]), {"A": 50, "B": 50}, 1.0, "2024-01-01", "2024-12-31").count() == 0
    m = portfolio.metrics(got, 10000.0, "2024-01-01", "2024-12-31").first()
    assert m.total_return == pytest.approx(15.5) and m.max_drawdown == 0
    with pytest.raises(ValueError):
        portfolio.simulate(df, {"A": 50, "B": 40}, 1.0, "2024-01-01", "2024-12-31")
    by_day = portfolio.simulate(df, {"A": 50, "B": 50}, 10000.0, "2024-01-01", "2024-12-31", align="date")
    near(column(by_day, "value", "i"), [10000, 10000, 11550])


def test_equal_weights(spark):
    want = {3: [33, 33, 34], 6: [17] * 5 + [15], 7: [14] * 6 + [16], 8: [13] * 7 + [9], 9: [11] * 8 + [12]}
    for n, weights in want.items():
        symbols = spark.createDataFrame([(i, str(i)) for i in range(1, n + 1)], "ordinal int, symbol string")
        assert column(portfolio.equal_weights(symbols), "weight", "ordinal") == weights


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_signals(spark):
    rsi = [value(spark, signals.from_rsi(F.lit(float(x)))) for x in (20, 30, 50, 70, 80)]
    assert rsi == ["strong_buy", "buy", "neutral", "sell", "strong_sell"]
    ma = [value(spark, signals.from_average(F.lit(float(p)), F.lit(100.0))) for p in (106, 105, 100, 95, 94)]
    assert ma == ["strong_buy", "buy", "neutral", "sell", "strong_sell"]
    assert value(spark, signals.from_average(F.lit(1.0), F.lit(0.0))) == "strong_buy"
    assert value(spark, signals.panel_label(F.lit(1.0), F.lit(1.0))) == "Sell"
    none = F.lit(None).cast("string")
    assert value(spark, signals.combine([none, none])) == "neutral"
    for pair, level in ((("strong_buy", "buy"), "strong_buy"), (("buy", "neutral"), "buy"), (("sell", "neutral"), "sell"), (("strong_sell", "sell"), "strong_sell")):
        assert value(spark, signals.combine([F.lit(x) for x in pair] + [none])) == level
    assert value(spark, signals.rsi_zone(F.lit(None).cast("double"))) == "Neutral"
    assert [value(spark, signals.correlation_class(F.lit(x))) for x in (0.7, 0.3, -0.3, -0.7, -0.71)] == ["strong_positive", "positive", "neutral", "negative", "strong_negative"]


def test_formats(spark):
    f = lambda fn, x: value(spark, fn(F.lit(float(x))))
    assert [f(scalar.dollar_volume, x) for x in (700, 1.5e6, 2.34e12)] == ["$1K", "$1.5M", "$2.3T"]
    assert [f(scalar.volume, x) for x in (999, 1500)] == ["999", "1.5K"] and f(scalar.compact_volume, 1600) == "2K"
    assert [f(scalar.percent, x) for x in (0, -1.5)] == ["+0.00%", "-1.50%"]
    assert f(scalar.currency, -1234.5) == "-$1,234.50" and f(scalar.number, 1200) == "1.2K" and f(scalar.number, 3e6) == "3M"
    assert [f(lambda c: scalar.half_up(c, 0), x) for x in (2.5, -2.5)] == [3.0, -2.0]
    assert value(spark, scalar.fallback(F.lit(0.0), 7.0)) == 7.0 and value(spark, scalar.date_part(F.lit("2024-01-02T03:04"))) == "2024-01-02"


def test_market_hours(spark):
    times = ["2024-07-01 13:30:00", "2024-07-06 15:00:00", "2024-07-01 20:00:00", "2024-07-01 20:01:00"]
    assert [value(spark, scalar.market_open(F.lit(t).cast("timestamp_ntz"))) for t in times] == [True, False, True, False]


def test_ranges(spark):
    df = bars(spark, s=range(1, 400))
    assert timeframe.in_range(df, "1W", "2024-12-31").count() == 8
    assert timeframe.in_range(df, "nonsense", "2024-12-31").count() == 31
    assert timeframe.between_days(df, "2024-01-01", "2024-01-03").count() == 3
    assert timeframe.interval_for("5Y") == "1wk" and timeframe.interval_for("??") == "1d" and timeframe.history_interval("ALL") == "1mo"
    with pytest.raises(ValueError):
        timeframe.interval_for("1Y", "3s")


def test_normalized_keeps_the_last_of_a_day(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 10.0), ("a", t + dt.timedelta(hours=1), 11.0), ("a", t + dt.timedelta(days=1), 12.0), ("b", t + dt.timedelta(days=2), 5.0)]
    got = compare.normalized(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), ["a", "b"]).orderBy("date").collect()
    assert [(r.a and round(r.a, 6), r.b) for r in got] == [(10.0, None), (20.0, None), (None, 0.0)]


def test_sources(spark, tmp_path):
    assert readers.symbols_of("A,,B") == ["A", "B"]
    with pytest.raises(ValueError):
        readers.symbols_of(",")
    nested = dims.regions(spark)
    assert nested.count() == 4 and nested.select(F.explode("countries")).count() == 25
    assert nested.select(F.explode("countries").alias("c")).select(F.explode("c.breakdown")).count() == 70
    assert nested.agg(F.sum("percent").alias("p")).first().p == 100 and dims.events(spark).count() == 52
    df = bars(spark, s=X).selectExpr("symbol", "ts", "close AS open", "close AS high", "close AS low", "close", "1D AS volume")
    readers.write(df, str(tmp_path / "bars"), by=["symbol"])
    assert readers.read_bars(spark, str(tmp_path / "bars")).where("symbol = 's'").count() == 10
    gaps = spark.createDataFrame([("s", None, None)], "symbol string, close double, volume double")
    assert tuple(readers.fill_bars(gaps).first()) == ("s", 0.0, 0.0)
    empty = bars(spark)
    assert indicators.with_sma(empty, [3]).count() == 0 and compare.period_returns(empty, "2024-01-01").count() == 0
    assert liquidity.summary(days(spark, [])).first().total_volume == 0


def test_sorted_outputs(spark, sf_dir):
    from tickforge.plans import catalog

    rows = {n: catalog.queries()[n](spark, sf_dir).collect() for n in ("liquidity_history", "normalized_compare", "source_order", "symbol_filter")}
    for name, key in (("liquidity_history", "date"), ("normalized_compare", "date"), ("source_order", "place"), ("symbol_filter", "ordinal")):
        got = [r[key] for r in rows[name]]
        assert len(got) > 1 and got == sorted(got), name


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_peaks_are_chained_over_slices(spark, rows):
    found = portfolio.drawdowns(bars(spark, s=X, t=X[::-1]), ["symbol"], "ts", "close", rows=rows)
    near(column(found.where("symbol = 's'"), "drawdown"), [0, 0, 0, 100 / 12, 200 / 12, 25, 200 / 12, 0, 0, 100 / 14])


def test_a_missing_price_ends_an_average(spark):
    gaps = bars(spark, s=X).withColumn("close", F.when(F.dayofmonth("ts") != 6, F.col("close")))
    for rows in (3, 100):
        near(column(indicators.with_ema(gaps, [3], rows=rows), "ema_3"), [None, None, 11, 11, 10.5] + [None] * 5)
    assert indicators.latest_ema(gaps, 3).first().ema is None


def test_weight_totals(spark):
    rows = [("a", "x", 60.0), ("a", "y", 40.0), ("b", "x", 60.0), ("c", "x", 100.0), ("c", "y", None)]
    got = portfolio.weight_totals(spark.createDataFrame(rows, "p string, symbol string, weight double"), ["p"])
    assert {r.p: (r.members, r.total_weight, r.is_valid) for r in got.collect()} == {"a": (2, 100.0, True), "b": (1, 60.0, False), "c": (2, 100.0, True)}


def test_summaries_merge(spark):
    """Any cut of a series gives the summary of the whole: in tasks, in plans, and against plain loops."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.where(rng.random(n := rng.integers(0, 30)) < 0.15, rng.choice([0.0, np.nan], n), rng.random(n) * 50)
        want = summary.of(x)
        got = summary.EMPTY
        for part in np.split(x, np.sort(rng.integers(0, n + 1, 4))):
            got = summary.then(got, summary.of(part))
        assert got == pytest.approx(want, nan_ok=True), x
        known = [v for v in x if v == v]
        falls = [(max(known[: i + 1]) - v) / max(known[: i + 1]) * 100 for i, v in enumerate(known) if max(known[: i + 1]) > 0]
        rets = [(b - a) / a for a, b in zip(x, x[1:]) if a == a and b == b and a != 0]
        assert want[5] == pytest.approx(max(falls, default=0)) and want[6] == len(rets)
        if rets:
            assert (want[7], want[8]) == (pytest.approx(np.mean(rets)), pytest.approx(np.var(rets) * len(rets), abs=1e-9))
    series = {s: [None if v != v else float(v) for v in np.where(rng.random(50) < 0.1, np.nan, rng.random(50) * 9)] for s in "abc"}
    rows = [(s, k // 7, [float("nan") if v is None else v for v in x[k : k + 7]]) for s, x in series.items() for k in range(0, 50, 7)]
    parts = summary.by_chunk(spark.createDataFrame(rows, "name string, q long, values array<double>"), ["name", "q"])
    flat = spark.createDataFrame([(s, i, v) for s, x in series.items() for i, v in enumerate(x)], "name string, i int, v double").repartition(6)
    by_rows = {r.name: tuple(r.s) for r in summary.by_series(flat, ["name"], ["i"], "v").collect()}
    for r in summary.folded(parts, ["name"], "q").collect():
        want = summary.of(np.array(series[r.name], np.float64))
        assert tuple(r.s) == pytest.approx(want) and by_rows[r.name] == pytest.approx(want)


@pytest.mark.parametrize("block, positions", [(1, 2), (2, 3), (128, 1024)])
@pytest.mark.parametrize("align", ["position", "date"])
def test_portfolios_in_blocks(spark, align, block, positions):
    """Each portfolio of a table is what simulate and metrics give for it alone."""
    prices = {"A": [100, 110, 121, 130, 90], "B": [50, 45, 55], "C": [10, 10, 20, 30], "D": [5]}
    df = bars(spark, **prices).where("not (symbol = 'C' and ts = '2024-01-02')")
    mixes = {"p": {"A": 50, "B": 50}, "q": {"C": 100}, "r": {"A": 20, "B": 30, "C": 50}, "short": {"D": 60, "A": 40}, "off": {"A": 99}, "gone": {"E": 100}, "zero": {"A": 100, "B": 0}}
    rows = [(p, s, float(w), 9) for p, mix in mixes.items() for s, w in mix.items()] + [("q", None, 5.0, 9), (None, "A", 100.0, 9), ("void", "A", None, 9)]
    asked = spark.createDataFrame(rows, "portfolio string, symbol string, weight double, members int")
    status, found = backtest.simulate_all(df, asked, 1000.0, "2024-01-01", "2024-12-31", align, block_symbols=block, positions=positions)
    states = {r.portfolio: r.status for r in status.collect()}
    assert states == {"p": "ok", "q": "ok", "r": "ok", "zero": "ok", "short": "bars", "off": "weights", "gone": "bars", "void": "weights"}
    values = {p: [] for p in states}
    for row in backtest.series(found, positions).orderBy("portfolio", "i").collect():
        values[row.portfolio].append(row.value)
    risks = {row.portfolio: tuple(row)[1:] for row in backtest.metrics_all(status, found, 1000.0, "2024-01-01", "2024-12-31").collect()}
    assert risks.keys() == states.keys()
    for p, state in states.items():
        if state != "ok":
            assert values[p] == [] and risks[p] == (state, *[None] * 5)
            continue
        alone = portfolio.simulate(df, mixes[p], 1000.0, "2024-01-01", "2024-12-31", align)
        near(values[p], column(alone, "value", "i"))
        near(risks[p][1:], tuple(portfolio.metrics(alone, 1000.0, "2024-01-01", "2024-12-31").first()))
    if align == "position":
        dated = backtest.with_dates(backtest.series(found, positions), df, asked, "2024-01-01", "2024-12-31")
        alone = portfolio.simulate(df, mixes["r"], 1000.0, "2024-01-01", "2024-12-31")
        assert column(dated.where("portfolio = 'r'"), "ts", "i") == column(alone, "ts", "i") and dated.where("ts is null").count() == 0
    assert backtest.simulate_all(df, asked.limit(0), 1.0, "2024-01-01", "2024-12-31")[1].count() == 0


def test_summaries_have_no_window(spark, sf_dir):
    from tickforge.plans import catalog

    plan = catalog.queries()["max_drawdown"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("FileScan") == 1
