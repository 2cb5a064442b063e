"""Back-tests of a table of portfolios in one plan.

Values are a sparse product: each portfolio's weights times the growth of its symbols. Growth is packed into tiles (a block of symbols by a
block of positions), weights into blocks of portfolios by the same blocks of symbols; a weight block meets the tiles of its symbols,
multiplies, and the parts of different symbol blocks are added up in a sorted stream. A portfolio's values come in chunks, a row for each block
of positions; risk is taken from summaries of chunks, merged in order. Weights never reach the driver, nor does any row hold a whole series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import correlation, indicators, portfolio, summary, timeframe

BLOCK_PORTFOLIOS, BLOCK_SYMBOLS, BLOCK_POSITIONS = 1024, 128, 1024
OK, BAD_WEIGHTS, TOO_SHORT = "ok", "weights", "bars"


def checked(allocations: DataFrame, bars_each: DataFrame) -> DataFrame:
    """(portfolio, members, total_weight, shortest, status) of allocations (portfolio, symbol, weight) and (symbol, n).

    status: 'weights' unless there are weights that add up to 100 (missing ones count as 0), else 'bars' unless each symbol has two bars or more, else 'ok'.
    """
    rows = allocations.join(bars_each, "symbol", "left")
    totals = portfolio.weight_totals(allocations, ["portfolio"])
    shortest = rows.groupBy("portfolio").agg(F.min(F.coalesce("n", F.lit(0))).alias("shortest"))
    status = F.when(~F.col("is_valid"), BAD_WEIGHTS).when(F.col("shortest") < 2, TOO_SHORT).otherwise(OK)
    return totals.join(shortest, "portfolio").select("portfolio", "members", "total_weight", "shortest", status.alias("status"))


def chunks(growth: DataFrame, weights: DataFrame, portfolios: int, symbols: int, block_symbols: int = BLOCK_SYMBOLS, positions: int = BLOCK_POSITIONS, block_portfolios: int = BLOCK_PORTFOLIOS) -> DataFrame:
    """(portfolio, q, values, found): sums of weight times growth, and how many symbols had a value, at positions q * `positions` and on.

    growth: (symbol, k, x), one a symbol and k. weights: (portfolio, symbol, weight), one a portfolio and symbol. `portfolios` and `symbols` are their numbers.
    """
    blocks, groups = max(1, -(-symbols // block_symbols)), max(1, -(-portfolios // block_portfolios))
    tiles = correlation.tiles(growth, blocks, positions)
    kind = dict(weights.dtypes)["portfolio"]
    block = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    entries = weights.withColumns({"block": block, "g": F.pmod(F.xxhash64("portfolio"), F.lit(groups)).cast("int")})
    packed = entries.groupBy("block", "g").agg(F.collect_list(F.struct("portfolio", "symbol", "weight")).alias("entries"))

    def multiply(batches):
        for b in batches:
            type_ = b.schema.field("entries").type.value_type.field("portfolio").type
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                entries = row.column(row.schema.get_field_index("entries")).flatten()
                names = row.column(row.schema.get_field_index("symbols")).flatten()
                at = pc.index_in(entries.field("symbol"), value_set=names)
                held = entries.field("portfolio").dictionary_encode()
                lane, here = held.indices.to_numpy(), ~at.is_null().to_numpy(zero_copy_only=False)
                column = at.fill_null(0).to_numpy()
                w = np.zeros((len(held.dictionary), len(names)))
                member = np.zeros(w.shape)
                w[lane[here], column[here]] = entries.field("weight").to_numpy(zero_copy_only=False)[here]
                member[lane[here], column[here]] = 1
                known = np.frombuffer(row.column(row.schema.get_field_index("known"))[0].as_py(), np.int8).reshape(-1, positions)
                x = np.nan_to_num(np.frombuffer(row.column(row.schema.get_field_index("x"))[0].as_py()).reshape(-1, positions))
                values, found = w @ x, member @ known.astype(np.float64)
                some = np.flatnonzero(found.any(axis=1))
                lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m[some].ravel()), positions).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([held.dictionary.cast(type_).take(pa.array(some)), row.column(row.schema.get_field_index("q")).take(pa.array(np.zeros(len(some), np.int64))), lists(values), lists(found)], names=["portfolio", "q", "values", "found"])

    schema = f"portfolio {kind}, q long, values array<double>, found array<double>"
    parts = packed.join(tiles, "block").select("entries", "symbols", "known", "x", "q").mapInArrow(multiply, schema)
    if blocks == 1:
        return parts

    def add(batches):
        key, sums = None, None
        for b in batches:
            out = []
            for p, q, *arrays in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(k).flatten().to_numpy().reshape(-1, positions) for k in (2, 3))):
                if key == (p, q):
                    sums = [s + a for s, a in zip(sums, arrays)]
                else:
                    if key is not None:
                        out.append((key, sums))
                    key, sums = (p, q), arrays
            kinds = b.schema
            if out:
                yield told(out, kinds)
        if key is not None:
            yield told([(key, sums)], kinds)

    def told(rows, kinds):
        lists = [pa.array([s[k] for _, s in rows], pa.list_(pa.float64())) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], kinds.field(0).type), pa.array([k[1] for k, _ in rows], pa.int64()), *lists], names=["portfolio", "q", "values", "found"])

    return parts.repartition("portfolio", "q").sortWithinPartitions("portfolio", "q").mapInArrow(add, schema)


def simulate_all(
    bars: DataFrame, allocations: DataFrame, amount: float, start: str, end: str, align: str = "position", whole_end_day: bool = False, block_symbols: int = BLOCK_SYMBOLS, positions: int = BLOCK_POSITIONS
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (portfolio, members, total_weight, shortest, status), a row a portfolio (see checked), and the values of those that are ok, in chunks (portfolio, q, values).

    allocations: (portfolio, symbol, weight in percent); equal pairs are added up, portfolios or symbols without a name are left out. The i-th bars of
    a portfolio's symbols add up, cut to its shortest series (align='position'), or those of one day (align='date', where days that a
    symbol lacks have no value). Counts of symbols and portfolios are taken first, for the number of blocks.
    """
    asked = allocations.where(F.col("portfolio").isNotNull() & F.col("symbol").isNotNull()).groupBy("portfolio", "symbol").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    part = timeframe.between_days(bars, start, end, whole_end_day=whole_end_day)
    status = checked(asked, part.groupBy("symbol").agg(F.count("*").alias("n")))
    n = asked.agg(F.count_distinct("portfolio").alias("p"), F.count_distinct("symbol").alias("s")).first()
    grown = indicators.with_base(indicators.positions(part) if align == "position" else part)
    key = F.col("rn") - 1 if align == "position" else F.datediff(F.to_date("ts"), F.lit(start).cast("date"))
    good = status.where(F.col("status") == OK)
    weights = asked.join(good.select("portfolio"), "portfolio").withColumn("weight", F.lit(float(amount)) * F.col("weight") / 100)
    found = chunks(grown.select("symbol", key.alias("k"), F.col("growth").alias("x")), weights, n.p, n.s, block_symbols, positions)
    # A value counts where all members have one.
    whole = found.join(good.select("portfolio", F.col("members").cast("double").alias("members")), "portfolio")
    values = F.transform(F.arrays_zip("values", "found"), lambda v: F.when(v["found"] == F.col("members"), v["values"]))
    return status, whole.select("portfolio", "q", values.alias("values"))


def series(found: DataFrame, positions: int = BLOCK_POSITIONS) -> DataFrame:
    """(portfolio, i, value): chunks as rows, numbered from 1 without the positions that have no value."""
    kept = found.withColumn("values", F.filter("values", lambda v: v.isNotNull()))
    before = F.sum(F.size("values")).over(Window.partitionBy("portfolio").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("_before", F.coalesce(before, F.lit(0))).select("portfolio", "_before", F.posexplode("values").alias("_i", "value")).select("portfolio", (F.col("_before") + F.col("_i") + 1).alias("i"), "value")


def with_dates(values: DataFrame, bars: DataFrame, allocations: DataFrame, start: str, end: str, ordinal: str = "symbol", whole_end_day: bool = False) -> DataFrame:
    """(portfolio, i, value) of series paired by position, and ts: the time of the i-th bar of the portfolio's first symbol, by a column of allocations (names, if none is given)."""
    first = allocations.where(F.col("portfolio").isNotNull() & F.col("symbol").isNotNull()).groupBy("portfolio").agg(F.min_by("symbol", ordinal).alias("symbol"))
    part = timeframe.between_days(bars, start, end, whole_end_day=whole_end_day)
    placed = indicators.positions(part).select("symbol", F.col("rn").alias("i"), "ts")
    return values.join(first, "portfolio").join(placed, ["symbol", "i"], "left").drop("symbol")


def metrics_all(status: DataFrame, found: DataFrame, amount: float, start: str, end: str, risk_free: float = 0.05, per_year: int = 252) -> DataFrame:
    """(portfolio, status, total_return, cagr, max_drawdown, volatility, sharpe), a row for each portfolio; nulls where the status isn't ok or no position is shared."""
    years = scalar.year_fraction(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    kept = found.withColumn("values", F.filter("values", lambda v: v.isNotNull()))
    sums = summary.folded(summary.by_chunk(kept, ["portfolio", "q"]), ["portfolio"], "q").where("s.n > 0")
    risks = sums.select("portfolio", *portfolio.measures(F.col("s"), F.lit(float(amount)), years, risk_free, per_year))
    return status.select("portfolio", "status").join(risks, "portfolio", "left")
