"""Bars, indicators, signals and comparison as queries on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, indicators, portfolio, signals, timeframe
from ..sources import adapters
from . import sql

AS_OF = adapters.DAILY_AS_OF
WEIGHTS, AMOUNT, START, END = {"A": 50.0, "N": 30.0, "R": 20.0}, 10_000.0, "1998-01-01", "2000-12-31"


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


def bars_in_range(spark, d):
    return timeframe.in_range(adapters.daily_bars(spark, d), "1Y", AS_OF).select("symbol", "ts", "close", "volume")


def bars_by_range(spark, d):
    """Bars of four ranges, each at its own width, and one at a width asked for, from one scan."""
    asked = [(k, None) for k in ("1D", "1W", "1M", "5Y")] + [("1D", "1h")]
    found = timeframe.bars_for_ranges(adapters.ticks(spark, d), asked, adapters.TICKS_AS_OF)
    return found.select("range", "width", "symbol", "ts", "open", "high", "low", "close", "volume")


def sma_50_200(spark, d):
    return indicators.with_sma(adapters.daily_bars(spark, d), [50, 200]).select("symbol", "ts", r("sma_50"), r("sma_200"))


def sma_sliced(spark, d):
    """The same from slices of 500 rows."""
    bars = adapters.daily_bars(spark, d)
    return indicators.in_slices(bars, 199, lambda cut: indicators.with_sma(cut, [50, 200]), rows=500).select("symbol", "ts", r("sma_50"), r("sma_200"))


def ema_12_26(spark, d):
    return indicators.with_ema(adapters.daily_bars(spark, d), [12, 26], rows=1000).select("symbol", "ts", r("ema_12"), r("ema_26"))


def ema_latest(spark, d):
    return indicators.latest_ema(adapters.daily_bars(spark, d), 12).select("symbol", r("ema"))


def rsi_14(spark, d):
    return indicators.with_rsi(adapters.daily_bars(spark, d), 14).select("symbol", "ts", r("rsi_14"))


def daily_changes(spark, d):
    return indicators.with_change(adapters.daily_bars(spark, d)).select("symbol", "ts", "change")


def daily_returns(spark, d):
    return indicators.with_returns(adapters.daily_bars(spark, d)).where("ret is not null").select("symbol", "ts", "ret")


def bar_direction(spark, d):
    monthly = timeframe.coarsen(adapters.daily_bars(spark, d), "1mo")
    return monthly.select("symbol", "ts", "open", "close", scalar.bar_direction(F.col("open"), F.col("close")).alias("direction"))


def ohlc_weekly(spark, d):
    return timeframe.coarsen(adapters.daily_bars(spark, d), "1wk").select("symbol", "ts", "open", "high", "low", "close", "volume")


def _ohlc(interval):
    return lambda spark, d: timeframe.resample(adapters.ticks(spark, d), interval).select("symbol", "ts", "open", "high", "low", "close", "volume")


def ma_crosses(spark, d):
    return indicators.average_crosses(adapters.daily_bars(spark, d)).select("symbol", "ts", F.col("cross").alias("cross_type"))


def recent_cross(spark, d):
    found = indicators.recent_cross(indicators.average_crosses(adapters.daily_bars(spark, d)))
    return found.select("symbol", "cross_ts", F.col("cross").alias("cross_type"), signals.cross_text(F.col("cross")).alias("banner"))


def signal_report(spark, d):
    found = signals.report(adapters.daily_bars(spark, d))
    return found.select("symbol", r("price"), r("rsi_14"), r("sma_50"), r("sma_200"), r("ema_12"), r("ema_26"), F.col("cross").alias("recent_cross"), "signal", signals.label(F.col("signal")).alias("label"), signals.place(F.col("signal")).cast("int").alias("place"))


def ma_panel(spark, d):
    return signals.panel(adapters.daily_bars(spark, d)).select("symbol", "average", r("value"), r("diff"), "label")


def rsi_zone(spark, d):
    rsi = F.col("rsi_14")
    return indicators.with_rsi(adapters.daily_bars(spark, d), 14).select("symbol", "ts", signals.rsi_zone(rsi).alias("zone"), signals.rsi_band(rsi).alias("band"), signals.from_rsi(rsi).alias("signal"))


def normalized_compare(spark, d):
    recent = timeframe.in_range(adapters.daily_bars(spark, d), "6M", AS_OF)
    return compare.normalized(recent, ["A", "N", "R"]).select("date", *(F.round(s, 4).alias(f"pct_{s.lower()}") for s in "ANR")).orderBy("date")


def growth_factors(spark, d):
    return indicators.with_base(timeframe.in_range(adapters.daily_bars(spark, d), "1Y", AS_OF)).select("symbol", "ts", r("growth", 6))


def period_returns(spark, d):
    found = compare.period_returns(adapters.daily_bars(spark, d), AS_OF)
    return found.select("symbol", *(F.round(f"ret_{p}", 4).alias(f"ret_{p.lower()}") for p in compare.PERIODS))


def _correlation(align):
    return lambda spark, d: compare.correlation_matrix(adapters.daily_bars(spark, d), align).select("sym_a", "sym_b", "n", r("corr", 6), F.col("class").alias("bucket"))


def portfolio_value(spark, d):
    return portfolio.simulate(adapters.daily_bars(spark, d), WEIGHTS, AMOUNT, START, END).select("i", "ts", r("value", 2), scalar.half_up(F.round("value", 6), 0).alias("whole"))


def portfolio_metrics(spark, d):
    values = portfolio.simulate(adapters.daily_bars(spark, d), WEIGHTS, AMOUNT, START, END)
    return portfolio.metrics(values, AMOUNT, START, END).select(*(r(c) for c in ("total_return", "cagr", "max_drawdown", "volatility", "sharpe")))


def portfolio_classes(spark, d):
    values = portfolio.simulate(adapters.daily_bars(spark, d), WEIGHTS, AMOUNT, START, END)
    return portfolio.classes(portfolio.metrics(values, AMOUNT, START, END)).select("return_class", "cagr_class", "sharpe_class")


def max_drawdown(spark, d):
    return portfolio.max_drawdown(adapters.daily_bars(spark, d), ["symbol"], "ts", "close").select("symbol", r("max_drawdown"))


def risk_by_symbol(spark, d):
    return portfolio.risk(adapters.daily_bars(spark, d), ["symbol"], "ts", "close").select("symbol", r("volatility"), r("sharpe"))


def running_peak(spark, d):
    return portfolio.drawdowns(adapters.daily_bars(spark, d), ["symbol"], "ts", "close").select("symbol", "ts", r("drawdown"))


QUERIES = {
    "bars_by_range": (
        bars_by_range,
        " UNION ALL ".join(
            f"(SELECT '{k}' AS range, '{i}' AS width, event_type AS symbol, {trunc} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE events.ts BETWEEN TIMESTAMP '{adapters.TICKS_AS_OF}' - INTERVAL {days} DAY AND TIMESTAMP '{adapters.TICKS_AS_OF}' GROUP BY event_type, {trunc})"
            for k, i, days, trunc in (("1D", "5m", 1, "time_bucket(INTERVAL 5 MINUTE, events.ts)"), ("1W", "15m", 7, "time_bucket(INTERVAL 15 MINUTE, events.ts)"), ("1M", "1d", 30, "date_trunc('day', events.ts)::TIMESTAMP"), ("5Y", "1wk", 1825, "date_trunc('week', events.ts)::TIMESTAMP"), ("1D", "1h", 1, "date_trunc('hour', events.ts)"))
        ),
    ),
    "bars_in_range": (bars_in_range, f"WITH {sql.BARS} SELECT symbol, ts, close, volume FROM bars WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}'"),
    "sma_50_200": (sma_50_200, f"WITH {sql.INDICATORS} SELECT symbol, ts, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200 FROM rsi"),
    "sma_sliced": (sma_sliced, f"WITH {sql.INDICATORS} SELECT symbol, ts, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200 FROM rsi"),
    "ema_12_26": (ema_12_26, f"WITH RECURSIVE {sql.BARS}, {sql.ema(12)}, {sql.ema(26)} SELECT b.symbol, b.ts, round(a.v, 4) AS ema_12, round(c.v, 4) AS ema_26 FROM bars b LEFT JOIN ema_12 a USING (symbol, rn) LEFT JOIN ema_26 c USING (symbol, rn)"),
    "ema_latest": (ema_latest, f"WITH RECURSIVE {sql.BARS}, {sql.ema(12)} SELECT symbol, round(arg_max(v, rn), 4) AS ema FROM ema_12 GROUP BY symbol"),
    "rsi_14": (rsi_14, f"WITH {sql.INDICATORS} SELECT symbol, ts, round(rsi_14, 4) AS rsi_14 FROM rsi"),
    "daily_changes": (daily_changes, f"WITH {sql.INDICATORS} SELECT symbol, ts, c AS change FROM changed"),
    "daily_returns": (daily_returns, f"WITH {sql.BARS}, x AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, ts, (close - p) / nullif(p, 0) AS ret FROM x WHERE (close - p) / nullif(p, 0) IS NOT NULL"),
    "bar_direction": (bar_direction, f"WITH {sql.BARS}, m AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts, arg_min(close, rn) AS open, arg_max(close, rn) AS close FROM bars GROUP BY 1, 2) SELECT symbol, ts, open, close, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM m"),
    "ohlc_weekly": (ohlc_weekly, f"WITH {sql.BARS} SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, arg_min(close, rn) AS open, max(close) AS high, min(close) AS low, arg_max(close, rn) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2"),
    **{
        f"ohlc_{name}": (_ohlc(i), f"SELECT event_type AS symbol, {trunc} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2")
        for name, i, trunc in (("5m", "5m", "time_bucket(INTERVAL 5 MINUTE, ts)"), ("15m", "15m", "time_bucket(INTERVAL 15 MINUTE, ts)"), ("hourly", "1h", "date_trunc('hour', ts)"), ("daily", "1d", "date_trunc('day', ts)::TIMESTAMP"), ("monthly", "1mo", "date_trunc('month', ts)::TIMESTAMP"))
    },
    "ma_crosses": (ma_crosses, f"WITH {sql.CROSSES} SELECT symbol, ts, cross_type FROM crosses"),
    "recent_cross": (recent_cross, f"WITH {sql.CROSSES}, l AS (SELECT symbol, max(ts) AS cross_ts, arg_max(cross_type, ts) AS cross_type FROM crosses GROUP BY symbol) SELECT *, CASE cross_type WHEN 'golden_cross' THEN 'Golden Cross: SMA-50 crossed above SMA-200' ELSE 'Death Cross: SMA-50 crossed below SMA-200' END AS banner FROM l"),
    "signal_report": (
        signal_report,
        f"""WITH RECURSIVE {sql.CROSSES}, {sql.ema(12)}, {sql.ema(26)}, now AS (
  SELECT r.symbol, r.close AS price, rsi_14, sma_50, sma_200, a.v AS ema_12, c.v AS ema_26 FROM rsi r LEFT JOIN ema_12 a USING (symbol, rn) LEFT JOIN ema_26 c USING (symbol, rn)
  QUALIFY row_number() OVER (PARTITION BY r.symbol ORDER BY r.rn DESC) = 1
), x AS (SELECT symbol, arg_max(cross_type, ts) AS recent_cross FROM crosses GROUP BY symbol),
scored AS (SELECT *, [{sql.signal_of_rsi('rsi_14')}, {', '.join(sql.signal_of_average('price', a) for a in ('sma_50', 'sma_200', 'ema_12', 'ema_26'))}] AS s FROM now LEFT JOIN x USING (symbol)),
done AS (SELECT *, {sql.level('list_avg(s)')} AS signal FROM scored)
SELECT symbol, round(price, 4) AS price, round(rsi_14, 4) AS rsi_14, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200, round(ema_12, 4) AS ema_12, round(ema_26, 4) AS ema_26, recent_cross, signal,
  CASE signal WHEN 'strong_buy' THEN 'Strong Buy' WHEN 'buy' THEN 'Buy' WHEN 'neutral' THEN 'Neutral' WHEN 'sell' THEN 'Sell' ELSE 'Strong Sell' END AS label,
  CAST(CASE signal WHEN 'strong_buy' THEN 4 WHEN 'buy' THEN 3 WHEN 'neutral' THEN 2 WHEN 'sell' THEN 1 ELSE 0 END AS INTEGER) AS place FROM done""",
    ),
    "ma_panel": (
        ma_panel,
        f"""WITH RECURSIVE {sql.INDICATORS}, {sql.ema(12)}, {sql.ema(26)}, now AS (
  SELECT r.symbol, r.close AS price, sma_50, sma_200, a.v AS ema_12, c.v AS ema_26 FROM rsi r LEFT JOIN ema_12 a USING (symbol, rn) LEFT JOIN ema_26 c USING (symbol, rn)
  QUALIFY row_number() OVER (PARTITION BY r.symbol ORDER BY r.rn DESC) = 1
), m AS (SELECT symbol, price, 'SMA 50' AS average, sma_50 AS value FROM now UNION ALL SELECT symbol, price, 'SMA 200', sma_200 FROM now UNION ALL SELECT symbol, price, 'EMA 12', ema_12 FROM now UNION ALL SELECT symbol, price, 'EMA 26', ema_26 FROM now)
SELECT symbol, average, round(value, 4) AS value, round((price - value) / nullif(value, 0) * 100, 4) AS diff, CASE WHEN (price - value) / nullif(value, 0) > 0 THEN 'Buy' ELSE 'Sell' END AS label FROM m WHERE value IS NOT NULL""",
    ),
    "rsi_zone": (
        rsi_zone,
        f"""WITH {sql.INDICATORS}, z AS (SELECT symbol, ts, rsi_14, coalesce(rsi_14, 50) AS r FROM rsi)
SELECT symbol, ts, CASE WHEN r <= 20 THEN 'Strongly Oversold' WHEN r <= 30 THEN 'Oversold' WHEN r >= 80 THEN 'Strongly Overbought' WHEN r >= 70 THEN 'Overbought' ELSE 'Neutral' END AS zone,
  CASE WHEN r <= 30 THEN 'low' WHEN r >= 70 THEN 'high' ELSE 'mid' END AS band,
  CASE WHEN rsi_14 <= 20 THEN 'strong_buy' WHEN rsi_14 <= 30 THEN 'buy' WHEN rsi_14 >= 80 THEN 'strong_sell' WHEN rsi_14 >= 70 THEN 'sell' ELSE 'neutral' END AS signal FROM z""",
    ),
    "normalized_compare": (
        normalized_compare,
        f"""WITH {sql.BARS}, p AS (SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY AND TIMESTAMP '{AS_OF}'), b AS (SELECT symbol, arg_min(close, ts) AS base FROM p GROUP BY symbol),
x AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_max((close - base) / nullif(base, 0) * 100, ts) AS pct FROM p JOIN b USING (symbol) GROUP BY 1, 2)
SELECT date, round(max(pct) FILTER (WHERE symbol = 'A'), 4) AS pct_a, round(max(pct) FILTER (WHERE symbol = 'N'), 4) AS pct_n, round(max(pct) FILTER (WHERE symbol = 'R'), 4) AS pct_r FROM x GROUP BY date""",
    ),
    "growth_factors": (growth_factors, f"WITH {sql.BARS}, p AS (SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}') SELECT symbol, ts, round(close / nullif(first_value(close) OVER (PARTITION BY symbol ORDER BY ts), 0), 6) AS growth FROM p"),
    "period_returns": (
        period_returns,
        f"WITH {sql.BARS} SELECT symbol, "
        + ", ".join(f"CASE WHEN count(*) FILTER ({w}) >= 2 THEN round((arg_max(close, ts) FILTER ({w}) - arg_min(close, ts) FILTER ({w})) / nullif(arg_min(close, ts) FILTER ({w}), 0) * 100, 4) END AS ret_{p.lower()}" for p, days in compare.PERIODS.items() for w in [f"WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"])
        + f" FROM bars WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}' GROUP BY symbol",
    ),
    **{
        name: (
            _correlation(align),
            f"""WITH {sql.BARS}, rets AS (SELECT symbol, {key} AS k, rn, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT a.symbol AS sym_a, b.symbol AS sym_b, count(*) AS n, coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0) AS corr FROM rets a JOIN rets b USING (k) WHERE a.rn > 1 AND b.rn > 1 GROUP BY 1, 2)
SELECT sym_a, sym_b, n, round(corr, 6) AS corr, CASE WHEN corr >= 0.7 THEN 'strong_positive' WHEN corr >= 0.3 THEN 'positive' WHEN corr >= -0.3 THEN 'neutral' WHEN corr >= -0.7 THEN 'negative' ELSE 'strong_negative' END AS bucket FROM c""",
        )
        for name, align, key in (("correlation_matrix", "position", "rn"), ("correlation_by_date", "date", "CAST(ts AS DATE)"))
    },
    "max_drawdown": (max_drawdown, f"WITH {sql.BARS}, p AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM bars) SELECT symbol, round(greatest(0, max((peak - close) / nullif(peak, 0) * 100)), 4) AS max_drawdown FROM p GROUP BY symbol"),
    "running_peak": (running_peak, f"WITH {sql.BARS} SELECT symbol, ts, round((max(close) OVER w - close) / nullif(max(close) OVER w, 0) * 100, 4) AS drawdown FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    "risk_by_symbol": (
        risk_by_symbol,
        f"WITH {sql.BARS}, x AS (SELECT symbol, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), v AS (SELECT symbol, avg(ret) AS m, coalesce(stddev_samp(ret), 0) * sqrt(252) AS vol FROM x GROUP BY symbol) SELECT symbol, round(vol * 100, 4) AS volatility, round(CASE WHEN vol = 0 THEN 0 ELSE (m * 252 - 0.05) / vol END, 4) AS sharpe FROM v",
    ),
}
_SIM = f"""{sql.BARS}, w(symbol, weight) AS (VALUES {', '.join(f"('{s}', {x}::DOUBLE)" for s, x in WEIGHTS.items())}),
part AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
sim AS (
  SELECT p.i, max(p.ts) FILTER (WHERE p.symbol = 'A') AS ts, sum({AMOUNT} * weight / 100 * p.close / b.close) AS value
  FROM part p JOIN w USING (symbol) JOIN part b ON b.symbol = p.symbol AND b.i = 1
  WHERE (SELECT min(n) FROM (SELECT count(part.ts) AS n FROM w LEFT JOIN part USING (symbol) GROUP BY w.symbol)) >= 2
  GROUP BY p.i HAVING count(*) = {len(WEIGHTS)}
)"""
QUERIES |= {
    "portfolio_value": (portfolio_value, f"WITH {_SIM} SELECT i, ts, round(value, 2) AS value, CAST(floor(round(value, 6) + 0.5) AS DOUBLE) AS whole FROM sim"),
    "portfolio_metrics": (
        portfolio_metrics,
        f"""WITH {_SIM}, x AS (SELECT i, value, value / lag(value) OVER (ORDER BY i) - 1 AS ret, max(value) OVER (ORDER BY i) AS peak FROM sim),
v AS (SELECT arg_max(value, i) AS last, greatest(0, max((peak - value) / peak * 100)) AS dd, coalesce(stddev_samp(ret), 0) * sqrt(252) AS vol, avg(ret) AS m FROM x)
SELECT round((last - {AMOUNT}) / {AMOUNT} * 100, 4) AS total_return, round((power(last / {AMOUNT}, 1 / (date_diff('day', DATE '{START}', DATE '{END}') / 365.25)) - 1) * 100, 4) AS cagr,
  round(dd, 4) AS max_drawdown, round(vol * 100, 4) AS volatility, round(CASE WHEN vol = 0 THEN 0 ELSE (m * 252 - 0.05) / vol END, 4) AS sharpe FROM v WHERE last IS NOT NULL""",
    ),
    "portfolio_classes": (
        portfolio_classes,
        f"""WITH {_SIM}, x AS (SELECT i, value, value / lag(value) OVER (ORDER BY i) - 1 AS ret, max(value) OVER (ORDER BY i) AS peak FROM sim),
v AS (SELECT arg_max(value, i) AS last, greatest(0, max((peak - value) / peak * 100)) AS dd, coalesce(stddev_samp(ret), 0) * sqrt(252) AS vol, avg(ret) AS m FROM x)
SELECT CASE WHEN last >= {AMOUNT} THEN 'positive' ELSE 'negative' END AS return_class, CASE WHEN last >= {AMOUNT} THEN 'positive' ELSE 'negative' END AS cagr_class,
  CASE WHEN CASE WHEN vol = 0 THEN 0 ELSE (m * 252 - 0.05) / vol END >= 1 THEN 'good' ELSE 'weak' END AS sharpe_class FROM v WHERE last IS NOT NULL""",
    ),
}
