"""Streaming counterparts: bars from ticks, request limits, and look-ups that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import indicators

# Seconds that answers stay fresh, by kind of query, and request limits.
TTL_SECONDS = {"quote": 30, "intraday": 60, "daily": 1800, "gold": 60}
LIMIT, LIMIT_WINDOW = 100, "60 seconds"


def stream_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): bars of a stream of ticks (symbol, ts, id, price); ticks later than `late` are left out."""
    order = F.struct("ts", "id")
    found = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return found.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def rate_limits(requests: DataFrame, limit: int = LIMIT, window: str = LIMIT_WINDOW, late: str = "2 minutes") -> DataFrame:
    """(client, ts, n, allowed, rejected): requests (client, ts) by client and window; batch or stream."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    found = rows.groupBy("client", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return found.select("client", F.col("w.start").alias("ts"), "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def cached_lookups(requests: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit) for a stream of requests (key, ts): a request within `ttl_seconds` of the last miss of its key is a hit.

    A key's state goes once the watermark, `late` behind the newest request, has passed its expiry.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        filled = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            hits = []
            for at in pdf.ts.astype("datetime64[us]").astype("int64"):
                hit = filled is not None and 0 <= at - filled < ttl_seconds * 10**6
                if not hit:
                    filled = int(at)
                hits.append(hit)
            yield pd.DataFrame({"key": key[0], "ts": pdf.ts, "hit": hits})
        state.update((filled,))
        state.setTimeoutTimestamp(max(filled // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = requests.withWatermark("ts", late).groupBy("key")
    return rows.applyInPandasWithState(serve, "key string, ts timestamp, hit boolean", "filled long", "append", GroupStateTimeout.EventTimeTimeout)


def lookup_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests (key, ts, id) and hit, in batch form: a request within `ttl_seconds` of the last miss of its key is a hit; ids order requests of one moment.

    After a gap as long as that, a request is a miss whatever came before. So each key's requests are cut at such gaps, found
    in slices of rows, and the parts are streamed in order by different tasks.
    """
    ttl = ttl_seconds * 10**6
    at = F.expr("unix_micros(cast(ts as timestamp))")
    rows = indicators.positions(requests.select(F.col("key").alias("symbol"), F.struct("ts", "id").alias("at"), "ts", "id"), tie="id")
    gap = at - F.lag(at).over(indicators.by_slice("at"))
    marked = indicators.in_slices(rows, 1, lambda cut: cut.withColumn("first", F.when(F.coalesce(gap >= ttl, F.lit(True)), F.col("rn"))), "at")
    parts = indicators.with_peak(marked, ("symbol",), "first").select("symbol", "peak", "ts", "id", at.alias("us"))

    def serve(batches):
        part, filled = None, 0
        for b in batches:
            hits = []
            for key, peak, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                hit = part == (key, peak) and us - filled < ttl
                if not hit:
                    part, filled = (key, peak), us
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(hits, pa.bool_())], names=["key", "ts", "id", "hit"])

    kinds = dict(parts.dtypes)
    ordered = parts.repartition("symbol", "peak").sortWithinPartitions("symbol", "peak", "us", "id")
    return ordered.mapInArrow(serve, f"key {kinds['symbol']}, ts {kinds['ts']}, id {kinds['id']}, hit boolean")


def polling(writer, market_is_open: bool):
    """A stream writer that polls every 30 seconds in market hours, every 300 outside."""
    return writer.trigger(processingTime=f"{30 if market_is_open else 300} seconds")
