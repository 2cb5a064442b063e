"""Common parts of the oracle SQL."""

from __future__ import annotations

from ..sources import static_tables as t


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bars(by: str, rows: str = "lineitem") -> str:
    """Day bars of lineitem, or of lineitem joined with other tables."""
    return f"""bars AS (
  SELECT symbol, ts, value / nullif(volume, 0) AS close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
  FROM (SELECT {by} AS symbol, l_shipdate AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM {rows} GROUP BY 1, 2)
)"""


BARS = bars("l_returnflag")
#: Ticks by symbol and day.
DAYS = """days AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS volume, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2
)"""
#: Dollar volume by day.
HISTORY = DAYS + """, history AS (
  SELECT date, sum(volume * close * CASE WHEN symbol = 'purchase' THEN 100 ELSE 1 END) AS total_volume FROM days GROUP BY date
)"""
INDICATORS = BARS + """, changed AS (
  SELECT *, close - lag(close) OVER w AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)
), ind AS (
  SELECT symbol, ts, close, volume, rn,
    CASE WHEN rn >= 50 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma_50,
    CASE WHEN rn >= 200 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma_200,
    sum(greatest(c, 0)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 AS gain,
    sum(greatest(-c, 0)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 AS loss
  FROM changed
), rsi AS (
  SELECT *, CASE WHEN rn <= 14 THEN NULL WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi_14 FROM ind
)"""
CROSSES = INDICATORS + """, lagged AS (
  SELECT symbol, ts, sma_50 AS s, sma_200 AS l, lag(sma_50) OVER w AS ps, lag(sma_200) OVER w AS pl FROM rsi WINDOW w AS (PARTITION BY symbol ORDER BY ts)
), crosses AS (
  SELECT symbol, ts, CASE WHEN ps <= pl AND s > l THEN 'golden_cross' WHEN ps >= pl AND s < l THEN 'death_cross' END AS cross_type
  FROM lagged WHERE (ps <= pl AND s > l) OR (ps >= pl AND s < l)
)"""


def ema(period: int) -> str:
    """Recursive averages as a table ema_<period>(symbol, rn, v)."""
    k = f"(2.0::DOUBLE / {period + 1})"
    return f"""ema_{period} AS (
  SELECT symbol, CAST({period} AS BIGINT) AS rn, avg(close) AS v FROM bars WHERE rn <= {period} GROUP BY symbol HAVING count(*) = {period}
  UNION ALL
  SELECT e.symbol, b.rn, (b.close - e.v) * {k} + e.v FROM ema_{period} e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1
)"""


EVENTS = "market_events(ordinal, event_date, title, description) AS (VALUES " + ", ".join(f"({i}, DATE '{d}', {text(a)}, {text(b)})" for i, (d, a, b) in enumerate(t.EVENTS)) + ")"
SOURCES = "sources(ordinal, key, name, percent, color) AS (VALUES " + ", ".join(f"({i}, '{k}', {text(n)}, {p}::DOUBLE, '{c}')" for i, (k, n, p, c) in enumerate(t.SOURCES)) + ")"
COUNTRIES = "countries(region, country, percent) AS (VALUES " + ", ".join(f"({text(r)}, {text(c[0])}, {c[2]}::DOUBLE)" for r, _, _, cs in t.REGIONS for c in cs) + ")"
DEMAND = "demand(country, type, percent, color) AS (VALUES " + ", ".join(f"({text(c[0])}, {text(k)}, {v}::DOUBLE, '{t.DEMAND_COLORS[k]}')" for _, _, _, cs in t.REGIONS for c in cs for k, v in c[3].items()) + ")"
TOTAL = HISTORY + ", total AS (SELECT coalesce(sum(total_volume), 0) AS total FROM history)"


def signal_of_average(price: str, average: str) -> str:
    d = f"(({price} - {average}) / nullif({average}, 0) * 100)"
    return f"CASE WHEN {average} = 0 AND {price} > 0 THEN 2 WHEN {average} = 0 AND {price} < 0 THEN -2 WHEN {d} > 5 THEN 2 WHEN {d} > 0 THEN 1 WHEN {d} < -5 THEN -2 WHEN {d} < 0 THEN -1 WHEN {average} IS NOT NULL THEN 0 END"


def signal_of_rsi(r: str) -> str:
    return f"CASE WHEN {r} <= 20 THEN 2 WHEN {r} <= 30 THEN 1 WHEN {r} >= 80 THEN -2 WHEN {r} >= 70 THEN -1 WHEN {r} IS NOT NULL THEN 0 END"


def level(mean: str) -> str:
    return f"CASE WHEN {mean} >= 1.5 THEN 'strong_buy' WHEN {mean} >= 0.5 THEN 'buy' WHEN {mean} <= -1.5 THEN 'strong_sell' WHEN {mean} <= -0.5 THEN 'sell' ELSE 'neutral' END"
