"""Indicators on a live stream of bars, with state that survives a restart.

Each symbol's state is a row: how many bars it had, when the last one was, the last closes (as many as the longest window looks back on),
exponential averages, and the two averages whose crossing is watched. A micro-batch's bars of a symbol are put in order and computed
together from it, so results equal those of the batch indicators on all bars so far. A symbol is one task; its state is bounded whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import indicators

STATE = "n long, last timestamp, closes array<double>, averages array<double>, short double, long double"
#: The store that keyed state needs; set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _means(x: np.ndarray, period: int, n: int) -> np.ndarray:
    """Means of the known values among the last `period`, for the last n of x; nan before there are as many rows."""
    out = np.full(n, np.nan)
    if len(x) >= period:
        windows = np.lib.stride_tricks.sliding_window_view(x, period)[-n:]
        known = ~np.isnan(windows)
        some = known.any(axis=1)
        total = np.where(known, windows, 0).sum(axis=1)
        out[n - len(windows) :] = np.where(some, total / np.maximum(known.sum(axis=1), 1), np.nan)
    return out


class Indicators(StatefulProcessor):
    """sma_, rsi_ and ema_ columns for the periods given, and crosses of the first two simple averages."""

    def __init__(self, sma: list[int], rsi: int, ema: list[int]):
        self.sma, self.rsi, self.ema = sma, rsi, ema
        self.keep = max([*sma, *ema, rsi + 1])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last, closes, averages, short, long = self.state.get() if self.state.exists() else (0, None, [], [], None, None)
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        new = new[~new.ts.duplicated()]
        if last is not None:
            new = new[new.ts > pd.Timestamp(last)]
        if not len(new):
            return
        before, fresh = np.array(closes, np.float64), new.close.to_numpy(np.float64)
        x, k = np.concatenate([before, fresh]), len(fresh)
        out = {"symbol": key[0], "ts": new.ts, "close": fresh, "rn": n + 1 + np.arange(k)}
        for p in self.sma:
            out[f"sma_{p}"] = _means(x, p, k)
        moves = np.diff(x)
        gain, loss = (_means(np.where(np.isnan(moves), np.nan, np.maximum(sign * moves, 0)), self.rsi, min(k, len(moves))) for sign in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))
        out[f"rsi_{self.rsi}"] = np.concatenate([np.full(k - len(found), np.nan), found])
        ends = []
        for i, p in enumerate(self.ema):
            values = np.full(k, np.nan)
            if n >= p:
                values = indicators.averages(fresh, 2 / (p + 1), averages[i])
            elif n + k >= p:  # all closes so far are here
                at = p - n - 1
                values[at] = x[:p].mean()
                values[at + 1 :] = indicators.averages(fresh[at + 1 :], 2 / (p + 1), values[at])
            out[f"ema_{p}"] = values
            ends.append(float(values[-1]))
        s, l = (np.concatenate([[np.nan if edge is None else edge], out[f"sma_{p}"]]) for edge, p in zip((short, long), self.sma))
        up, down = (s[:-1] <= l[:-1]) & (s[1:] > l[1:]), (s[:-1] >= l[:-1]) & (s[1:] < l[1:])
        out["cross"] = np.where(up, "golden_cross", np.where(down, "death_cross", None))
        self.state.update((n + k, new.ts.iloc[-1].to_pydatetime(), x[-self.keep :].tolist(), ends, float(s[-1]), float(l[-1])))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def with_indicators(bars: DataFrame, sma: tuple[int, int] = (50, 200), rsi: int = 14, ema: tuple[int, ...] = (12, 26)) -> DataFrame:
    """(symbol, ts, close, rn, sma_*, rsi_*, ema_*, cross) of a stream of bars (symbol, ts, close), appended as bars come.

    Missing closes are taken as the batch indicators take them. A bar that isn't later than its symbol's last one is left out, as is a second one of a moment
    in one batch. The session must use PROVIDER for state.
    """
    schema = ", ".join(["symbol string", "ts timestamp", "close double", "rn long", *(f"sma_{p} double" for p in sma), f"rsi_{rsi} double", *(f"ema_{p} double" for p in ema), "cross string"])
    return bars.select("symbol", "ts", "close").groupBy("symbol").transformWithStateInPandas(Indicators(list(sma), rsi, list(ema)), schema, "append", "None")
