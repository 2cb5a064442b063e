"""Series of many symbols, portfolios and users as queries on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import asof, backtest, compare, prefix, timeframe
from ..sources import adapters, barstore, quote_files, shared
from ..streaming import live, refresh, streams
from . import sql


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


def _supplier_correlation(align):
    return lambda spark, d: compare.correlation_matrix(adapters.daily_bars(spark, d, "l_suppkey"), align).select("sym_a", "sym_b", "n", scalar.half_away(F.col("corr"), 6).alias("corr"), F.col("class").alias("bucket"))


AMOUNT, START, END, SHORT_END = 10_000.0, "2000-01-01", "2000-12-31", "2000-03-31"


def portfolio_table(spark, d):
    """Each customer's mix of brands as a portfolio held for a year; those that are no portfolio say why."""
    status, found = backtest.simulate_all(adapters.brand_bars(spark, d), adapters.customer_mix(spark, d, "p_brand"), AMOUNT, START, END)
    return _risks(backtest.metrics_all(status, found, AMOUNT, START, END))


def portfolio_table_by_date(spark, d):
    """Each customer's mix of return flags, on days on which all were traded."""
    status, found = backtest.simulate_all(adapters.daily_bars(spark, d), adapters.customer_mix(spark, d, "l_returnflag"), AMOUNT, START, END, align="date")
    return _risks(backtest.metrics_all(status, found, AMOUNT, START, END))


def portfolio_table_values(spark, d):
    bars, mixes = adapters.brand_bars(spark, d), adapters.customer_mix(spark, d, "p_brand")
    _, found = backtest.simulate_all(bars, mixes, AMOUNT, START, SHORT_END)
    dated = backtest.with_dates(backtest.series(found), bars, mixes, START, SHORT_END)
    return dated.select("portfolio", F.col("i").cast("long").alias("i"), "ts", r("value", 2))


def _risks(found):
    return found.select("portfolio", "status", *(r(c) for c in ("total_return", "cagr", "max_drawdown", "volatility", "sharpe")))


def _mix(by: str) -> str:
    return f"""bought AS (SELECT o_custkey AS portfolio, {by} AS symbol, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
w AS (SELECT portfolio, symbol, floor(n * 100 / sum(n) OVER (PARTITION BY portfolio) + 0.5) AS weight FROM bought)"""


def _simulated(by: str, end: str, key: str) -> str:
    rows = "lineitem JOIN part ON l_partkey = p_partkey"
    return f"""{sql.bars(by, rows)}, {_mix(by)},
part_ AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{end}'),
grown AS (SELECT p.symbol, p.{key} AS k, p.close / nullif(b.close, 0) AS growth FROM part_ p JOIN part_ b ON b.symbol = p.symbol AND b.i = 1),
checked AS (SELECT portfolio, count(*) AS members, CASE WHEN sum(weight) <> 100 THEN 'weights' WHEN min(coalesce(n, 0)) < 2 THEN 'bars' ELSE 'ok' END AS status
  FROM w LEFT JOIN (SELECT symbol, count(*) AS n FROM part_ GROUP BY 1) USING (symbol) GROUP BY portfolio),
values_ AS (SELECT portfolio, k, sum({AMOUNT} * weight / 100 * growth) AS value FROM w JOIN checked USING (portfolio) JOIN grown USING (symbol) WHERE status = 'ok' GROUP BY portfolio, k, members HAVING count(*) = members)"""


def _measured(by: str, key: str) -> str:
    return f"""WITH {_simulated(by, END, key)},
x AS (SELECT portfolio, k, value, value / lag(value) OVER w - 1 AS ret, max(value) OVER w AS peak FROM values_ WINDOW w AS (PARTITION BY portfolio ORDER BY k)),
v AS (SELECT portfolio, arg_max(value, k) AS last, greatest(0, max((peak - value) / peak * 100)) AS dd, coalesce(stddev_samp(ret), 0) * sqrt(252) AS vol, avg(ret) AS m FROM x GROUP BY portfolio)
SELECT portfolio, status, round((last - {AMOUNT}) / {AMOUNT} * 100, 4) AS total_return, round((power(last / {AMOUNT}, 1 / (date_diff('day', DATE '{START}', DATE '{END}') / 365.25)) - 1) * 100, 4) AS cagr,
  round(dd, 4) AS max_drawdown, round(vol * 100, 4) AS volatility, round(CASE WHEN vol = 0 THEN 0 ELSE (m * 252 - 0.05) / vol END, 4) AS sharpe FROM checked LEFT JOIN v USING (portfolio)"""


ALL_WIDTHS = {"5m": "time_bucket(INTERVAL 5 MINUTE, ts)", "15m": "time_bucket(INTERVAL 15 MINUTE, ts)", "1h": "date_trunc('hour', ts)", "1d": "date_trunc('day', ts)::TIMESTAMP", "1wk": "date_trunc('week', ts)::TIMESTAMP", "1mo": "date_trunc('month', ts)::TIMESTAMP"}
REACH_HOURS = 6


def bars_all_widths(spark, d):
    return timeframe.resample_all(adapters.ticks(spark, d), list(ALL_WIDTHS)).select("symbol", "width", "ts", "open", "high", "low", "close", "volume", "n")


def _user_ticks(spark, d):
    e = adapters.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("ordinal"), "value")


def _purchases(direction, reach=None):
    def query(spark, d):
        ticks, bought = _user_ticks(spark, d)
        found = asof.join_asof(ticks, bought, ["user_id"], direction=direction, reach_seconds=reach)
        gap = F.unix_micros(F.col("match.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
        return found.select("event_id", "user_id", F.col("match.ordinal").alias("purchase_id"), F.col("match.value").alias("value"), gap.alias("micros"))

    return query


def _nearest_sql(condition: str) -> str:
    return f"""WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), t AS (SELECT * FROM events WHERE event_type <> 'purchase'),
m AS (SELECT t.event_id, p.event_id AS purchase_id, p.value, epoch_us(p.ts) - epoch_us(t.ts) AS micros FROM t JOIN p ON p.user_id = t.user_id AND {condition} QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(t.ts)), p.event_id) = 1)
SELECT event_id, user_id, purchase_id, m.value, micros FROM t LEFT JOIN m USING (event_id)"""


LONG, SHORT_SLICE = (500, 1200), 256


def sma_long(spark, d):
    """Averages over more rows than a slice has."""
    return prefix.with_sma(adapters.daily_bars(spark, d), list(LONG), rows=SHORT_SLICE).select("symbol", "ts", *(r(f"sma_{p}") for p in LONG))


def rsi_long(spark, d):
    return prefix.with_rsi(adapters.daily_bars(spark, d), LONG[0], rows=SHORT_SLICE).select("symbol", "ts", r(f"rsi_{LONG[0]}"))


STORE_ROWS, STORE_LOOKBACK = 1024, 640


def stored_indicators(spark, d):
    """Averages and the oscillator of a bar store written from lineitem: after that, no shuffle."""
    name = barstore.write(adapters.daily_bars(spark, d), rows=STORE_ROWS, lookback=STORE_LOOKBACK)
    found = barstore.with_indicators(spark, name, sma=[50, 200], rsi=[14], ema=[12, 26])
    return found.select("symbol", "ts", *(r(c) for c in ("sma_50", "sma_200", "rsi_14", "ema_12", "ema_26")))


def stored_range(spark, d):
    """A year of each supplier's bars from a store: other years' files aren't read."""
    name = barstore.write(adapters.daily_bars(spark, d, "l_suppkey"), rows=STORE_ROWS, lookback=1)
    return barstore.in_range(spark, name, "1Y", adapters.DAILY_AS_OF).select("symbol", "ts", "close", "volume")


STREAM_CUT = "1999-01-01"


def stream_indicators(spark, d):
    """Indicators of a stream of bars that comes in two parts, with a restart between them."""
    at = shared.new_path(spark, "live")
    bars = adapters.daily_bars(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.PROVIDER)
    try:
        for part in (F.col("ts") < STREAM_CUT, F.col("ts") >= STREAM_CUT):
            bars.where(part).write.mode("append").parquet(f"{at}/bars")
            found = live.with_indicators(spark.readStream.schema(bars.schema).parquet(f"{at}/bars"))
            found.writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    found = spark.read.parquet(f"{at}/found")
    return found.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "rn", *(r(c) for c in ("sma_50", "sma_200", "rsi_14", "ema_12", "ema_26")), F.col("cross").alias("cross_type"))


def refreshed_spikes(spark, d):
    """Spikes of ticks that come in three batches, one of them twice."""
    at = shared.new_path(spark, "refresh")
    ticks = adapters.ticks(spark, d)
    for batch in (0, 1, 1, 2):
        refresh.upsert(ticks.where(F.col("id") % 3 == batch), batch, at, adapters.FUTURES)
    return refresh.spikes(spark, at, adapters.FUTURES, top=None).select("date", r("total_volume"), r("deviation"))


QUOTES_FROM, QUOTES_TO = "2024-01-10 06:30:00", "2024-01-12"


def quotes_from_files(spark, d):
    """Hourly quotes as JSON files, read back through the data source: two symbols and two days, other files aren't opened."""
    at = shared.new_path(spark, "quotes")
    bars = timeframe.resample(adapters.ticks(spark, d), "1h")
    quote_files.write(bars.select("symbol", "ts", F.col("close").alias("price"), "volume"), at)
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (QUOTES_FROM, QUOTES_TO))
    found = quote_files.read(spark, at)
    return found.where(F.col("symbol").isin("click", "view") & (F.col("ts") >= lo) & (F.col("ts") < hi))


TICKS_CUT = "2024-01-16"


def streamed_bars(spark, d):
    """Quarter-hour bars of a stream of ticks that comes in two parts, with a restart between them: those that no later tick can change."""
    at = shared.new_path(spark, "ticks")
    ticks = adapters.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (F.col("ts") < TICKS_CUT, F.col("ts") >= TICKS_CUT):
        ticks.where(part).write.mode("append").parquet(f"{at}/ticks")
        found = streams.stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{at}/ticks"), "15 minutes", "0 seconds")
        found.writeStream.format("parquet").outputMode("append").option("path", f"{at}/bars").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/bars").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


QUERIES = {
    "streamed_bars": (
        streamed_bars,
        "WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, events.ts) AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (events.ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2) SELECT * FROM b WHERE b.ts + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events)",
    ),
    "quotes_from_files": (
        quotes_from_files,
        f"SELECT event_type AS symbol, date_trunc('hour', events.ts) AS ts, arg_max(value, (events.ts, event_id)) AS price, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE event_type IN ('click', 'view') AND date_trunc('hour', events.ts) >= TIMESTAMP '{QUOTES_FROM}' AND date_trunc('hour', events.ts) < TIMESTAMP '{QUOTES_TO}' GROUP BY 1, 2",
    ),
    "stream_indicators": (
        stream_indicators,
        f"""WITH RECURSIVE {sql.CROSSES}, {sql.ema(12)}, {sql.ema(26)}
SELECT r.symbol, r.ts, r.rn, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200, round(rsi_14, 4) AS rsi_14, round(a.v, 4) AS ema_12, round(c.v, 4) AS ema_26, x.cross_type
FROM rsi r LEFT JOIN ema_12 a USING (symbol, rn) LEFT JOIN ema_26 c USING (symbol, rn) LEFT JOIN crosses x ON x.symbol = r.symbol AND x.ts = r.ts""",
    ),
    "refreshed_spikes": (
        refreshed_spikes,
        f"WITH {sql.HISTORY}, stats AS (SELECT avg(total_volume) AS mean, stddev_pop(total_volume) AS std, count(*) AS n FROM history) SELECT date, round(total_volume, 4) AS total_volume, round((total_volume - mean) / std, 4) AS deviation FROM history, stats WHERE n >= 10 AND std > 0 AND (total_volume - mean) / std > 1.2",
    ),
    "stored_indicators": (
        stored_indicators,
        f"WITH RECURSIVE {sql.INDICATORS}, {sql.ema(12)}, {sql.ema(26)} SELECT r.symbol, r.ts, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200, round(rsi_14, 4) AS rsi_14, round(a.v, 4) AS ema_12, round(c.v, 4) AS ema_26 FROM rsi r LEFT JOIN ema_12 a USING (symbol, rn) LEFT JOIN ema_26 c USING (symbol, rn)",
    ),
    "stored_range": (stored_range, f"WITH {sql.bars('l_suppkey')} SELECT symbol, ts, close, volume FROM bars WHERE ts BETWEEN TIMESTAMP '{adapters.DAILY_AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{adapters.DAILY_AS_OF}'"),
    "sma_long": (sma_long, f"WITH {sql.BARS} SELECT symbol, ts, " + ", ".join(f"round(CASE WHEN rn >= {p} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) END, 4) AS sma_{p}" for p in LONG) + " FROM bars"),
    "rsi_long": (
        rsi_long,
        f"""WITH {sql.BARS}, c AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM bars),
s AS (SELECT symbol, ts, rn, sum(greatest(c, 0)) OVER w AS gain, sum(greatest(-c, 0)) OVER w AS loss FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {LONG[0] - 1} PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(CASE WHEN rn <= {LONG[0]} THEN NULL WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END, 4) AS rsi_{LONG[0]} FROM s""",
    ),
    "bars_all_widths": (
        bars_all_widths,
        " UNION ALL ".join(f"(SELECT event_type AS symbol, '{w}' AS width, {trunc} AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (events.ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS n FROM events GROUP BY event_type, {trunc.replace('ts)', 'events.ts)')})" for w, trunc in ALL_WIDTHS.items()),
    ),
    "nearest_purchase": (_purchases(asof.NEAREST), _nearest_sql("true")),
    "last_purchase": (_purchases(asof.BEFORE, 3600 * REACH_HOURS), _nearest_sql(f"p.ts <= t.ts AND p.ts >= t.ts - INTERVAL {REACH_HOURS} HOUR")),
    "next_purchase": (_purchases(asof.AFTER), _nearest_sql("p.ts >= t.ts")),
    "portfolio_table": (portfolio_table, _measured("p_brand", "i")),
    "portfolio_table_by_date": (portfolio_table_by_date, _measured("l_returnflag", "ts")),
    "portfolio_table_values": (portfolio_table_values, f"WITH {_simulated('p_brand', SHORT_END, 'i')} SELECT v.portfolio, k AS i, p.ts, round(value, 2) AS value FROM values_ v JOIN (SELECT portfolio, min(symbol) AS symbol FROM w GROUP BY 1) f USING (portfolio) LEFT JOIN part_ p ON p.symbol = f.symbol AND p.i = v.k"),
    **{
        name: (
            _supplier_correlation(align),
            f"""WITH {sql.bars('l_suppkey')}, rets AS (SELECT symbol, {key} AS k, rn, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT a.symbol AS sym_a, b.symbol AS sym_b, count(*) AS n, coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0) AS corr FROM rets a JOIN rets b USING (k) WHERE a.rn > 1 AND b.rn > 1 GROUP BY 1, 2)
SELECT sym_a, sym_b, n, round(corr, 6) AS corr, CASE WHEN corr >= 0.7 THEN 'strong_positive' WHEN corr >= 0.3 THEN 'positive' WHEN corr >= -0.3 THEN 'neutral' WHEN corr >= -0.7 THEN 'negative' ELSE 'strong_negative' END AS bucket FROM c""",
        )
        for name, align, key in (("supplier_correlation", "position", "rn"), ("supplier_correlation_by_date", "date", "CAST(ts AS DATE)"))
    },
}
