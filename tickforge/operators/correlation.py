"""Correlation of all pairs of symbols, by products of tiles.

Values (symbol, k, x) are packed into tiles, a block of symbols by a block of positions, that hold just the values there are. Blocks are dealt
into strips, and each tile is sent to every strip, so that two strips of the same range of positions meet in a task. It goes through the pairs of
their blocks: a few matrix products give the sums of all pairs of symbols, and one pair of blocks leaves the task before the next. Values are
sent as often as there are strips, which is as few as let two strips be held. If one range holds all positions, a pair is told where it is
summed up; else the sums of ranges are added up by pair. So no row holds more than a tile and no task more than two strips, whatever the number
of symbols or the length of their series. The result has a row for each pair: its size grows with the square of the symbols.

Sums are of distances from each symbol's mean in its range; the means of ranges come in apart. What cancels is only between ranges: values whose
mean is 10^5 times their deviation or more lose digits (returns are nowhere near that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SYMBOLS, BLOCK_POSITIONS = 128, 4096
#: Tiles of a range of positions; strips there are at least, if there are as many blocks; values of a strip, of which a task holds two.
RANGE_TILES, LEAST_STRIPS, STRIP_VALUES = 8, 16, 1 << 21
#: A variance below this share of the mean square is taken for none.
LEAST_VARIANCE = 1e-13
_SUMS = ("m", "sx", "sy", "cxx", "cyy", "cxy", "bxx", "byy", "bxy")


def tiles(values: DataFrame, blocks: int, positions: int = BLOCK_POSITIONS) -> DataFrame:
    """(block, q, symbols, known, x): matrices of values (symbol, k, x), symbols by positions, in binary; known tells which rows exist, missing values are nan."""
    kind = dict(values.dtypes)["symbol"]

    def pack(t: pa.Table) -> pa.Table:
        symbols = t.column("symbol").combine_chunks().dictionary_encode()
        row, at = symbols.indices.to_numpy(), t.column("k").to_numpy() % positions
        known = np.zeros((len(symbols.dictionary), positions), np.int8)
        x = np.full(known.shape, np.nan)
        known[row, at] = 1
        x[row, at] = t.column("x").to_numpy()
        names = pa.array([symbols.dictionary.to_pylist()], pa.list_(symbols.dictionary.type))
        return pa.table({"block": t.column("block")[:1], "q": t.column("q")[:1], "symbols": names, "known": pa.array([known.tobytes()]), "x": pa.array([x.tobytes()])})

    keyed = values.where(F.col("symbol").isNotNull()).withColumns({"block": F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"), "q": F.floor(F.col("k") / positions).cast("long")})
    return keyed.select("symbol", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"), "block", "q").groupBy("block", "q").applyInArrow(pack, f"block int, q long, symbols array<{kind}>, known binary, x binary")


def _sent(values: DataFrame, blocks: int, strips: int, positions: int) -> DataFrame:
    """(lo, hi, part, block, q, symbols, cells, x): tiles, each for all pairs of strips that its own is in. cells are the places (row times `positions` plus column) of the values x, in binary."""
    kind = dict(values.dtypes)["symbol"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        symbols = t.column("symbol").combine_chunks().dictionary_encode()
        cells = (symbols.indices.to_numpy().astype(np.int64) * positions + t.column("k").to_numpy() % positions).astype(np.int32)
        block, q = t.column("block")[0].as_py(), t.column("q")[0].as_py()
        names = pa.array([symbols.dictionary.to_pylist()], pa.list_(symbols.dictionary.type))
        held = {"block": pa.array([block], pa.int32()), "q": pa.array([q]), "symbols": names, "cells": pa.array([cells.tobytes()]), "x": pa.array([t.column("x").to_numpy().tobytes()])}
        for other in range(strips):
            lo, hi = sorted((block % strips, other))
            yield pa.RecordBatch.from_pydict({"lo": pa.array([lo], pa.int32()), "hi": pa.array([hi], pa.int32()), "part": pa.array([q // RANGE_TILES]), **held})

    keyed = values.where(F.col("symbol").isNotNull()).withColumns({"block": F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"), "q": F.floor(F.col("k") / positions).cast("long")})
    cut = keyed.select("symbol", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"), "block", "q").groupBy("block", "q")
    return cut.applyInArrow(pack, f"lo int, hi int, part long, block int, q long, symbols array<{kind}>, cells binary, x binary")


class _Block:
    """A block's symbols and its tiles in one range, as matrices when they are asked for."""

    def __init__(self, rows: list[dict], positions: int, type_: pa.DataType):
        lanes = {s: i for i, s in enumerate(dict.fromkeys(s for r in rows for s in r["symbols"]))}
        self.names, self.tiles, seen, total = pa.array(list(lanes), type_), {}, np.zeros(len(lanes)), np.zeros(len(lanes))
        for r in rows:
            cells, x = np.frombuffer(r["cells"], np.int32), np.frombuffer(r["x"])
            lane = np.array([lanes[s] for s in r["symbols"]])[cells // positions]
            self.tiles[r["q"]] = lane, cells % positions, x
            some = ~np.isnan(x)
            seen += np.bincount(lane[some], minlength=len(lanes))
            total += np.bincount(lane[some], x[some], minlength=len(lanes))
        self.mean = total / np.maximum(seen, 1)

    def matrices(self, widths: dict[int, tuple[int, int]]) -> dict[int, tuple[np.ndarray | None, ...]]:
        """By tile, of the columns in use: which rows exist (None: as those that have values), which have values, and distances from the mean."""
        out = {}
        for q, (lane, column, x) in self.tiles.items():
            first, end = widths[q]
            known, y = np.zeros((len(self.names), end - first)), np.zeros((len(self.names), end - first))
            gap = np.isnan(x)
            known[lane, column - first] = 1
            y[lane, column - first] = np.where(gap, 0, x - self.mean[lane])
            has = known
            if gap.any():
                has = known.copy()
                has[lane[gap], column[gap] - first] = 0
            out[q] = known if has is not known else None, has, y
        return out


def pair_sums(a: _Block, b: _Block, ma: dict, mb: dict) -> tuple[np.ndarray, ...] | None:
    """(n, *_SUMS) of all rows of a by all rows of b: how many positions both have, and for those with both values their number, sums, and co-moments within and between ranges. None if they share no tile."""
    n = m = dx = dy = qxx = qyy = qxy = 0
    shared = ma.keys() & mb.keys()
    for q in sorted(shared):
        (ka, fa, ya), (kb, fb, yb) = ma[q], mb[q]
        rows = len(fa)
        by_known, by_value = np.concatenate([fa, ya, ya * ya]) @ fb.T, np.concatenate([fa, ya]) @ yb.T
        both = by_known[:rows]
        n = n + (both if ka is None and kb is None else (fa if ka is None else ka) @ (fb if kb is None else kb).T)
        m, dx, qxx = m + both, dx + by_known[rows : 2 * rows], qxx + by_known[2 * rows :]
        dy, qxy, qyy = dy + by_value[:rows], qxy + by_value[rows:], qyy + fa @ (yb * yb).T
    if not shared:
        return None
    some = np.maximum(m, 1)
    sx, sy = dx + m * a.mean[:, None], dy + m * b.mean[None, :]
    return n, m, sx, sy, qxx - dx * dx / some, qyy - dy * dy / some, qxy - dx * dy / some, sx * sx / some, sy * sy / some, sx * sy / some


def pearson(m: np.ndarray, cxx: np.ndarray, cyy: np.ndarray, cxy: np.ndarray, bxx: np.ndarray, byy: np.ndarray) -> np.ndarray:
    """Of pairs whose sums are of one range: 0 with fewer than two positions, or without variance."""
    varies = (m >= 2) & (cxx > LEAST_VARIANCE * (cxx + bxx)) & (cyy > LEAST_VARIANCE * (cyy + byy))
    return np.divide(cxy, np.sqrt(np.maximum(cxx, 0)) * np.sqrt(np.maximum(cyy, 0)), out=np.zeros(m.shape), where=varies)


def _moment(c: str, b: str, s: str, t: str) -> Column:
    return F.col(c) + F.col(b) - F.try_divide(F.col(s) * F.col(t), "m")


def correlations(
    values: DataFrame, symbols: int, block_symbols: int = BLOCK_SYMBOLS, positions: int = BLOCK_POSITIONS, extent: tuple[int, int, int] | None = None, both: bool = False
) -> DataFrame:
    """(sym_a, sym_b, n, corr) of values (symbol, k, x), one a symbol and k: the upper triangle with the diagonal (`both`: both triangles), of symbols that share a position.

    n counts the shared positions, corr is Pearson's over those with both values: 0 with fewer than two, or without variance. `symbols` is their
    number, `extent` the number of values (not less), and the least and greatest k (or beyond), if these are known.
    """
    blocks = strips = max(1, -(-symbols // block_symbols))
    alone = False
    if extent:
        rows, first, last = extent
        ranges = -(-(last - first + 1) // (positions * RANGE_TILES))
        strips, alone = min(blocks, max(LEAST_STRIPS, -(-rows // (ranges * STRIP_VALUES)))), ranges == 1
        values = values.withColumn("k", F.col("k") - first)
    kind = dict(values.dtypes)["symbol"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, widths = {}, {}
        for b in batches:
            lo, hi, type_ = b.column("lo")[0].as_py(), b.column("hi")[0].as_py(), b.schema.field("symbols").type.value_type
            for r in b.select(["block", "q", "symbols", "cells", "x"]).to_pylist():
                rows.setdefault(r["block"], []).append(r)
                columns, known = np.frombuffer(r["cells"], np.int32) % positions, widths.get(r["q"], (positions, 0))
                widths[r["q"]] = min(known[0], int(columns.min())), max(known[1], int(columns.max()) + 1)
        held = {k: _Block(rows.pop(k), positions, type_) for k in sorted(rows)}
        for i, a in held.items():
            if i % strips != lo:
                continue
            ma = a.matrices(widths)
            for j, b in held.items():
                if j % strips != hi or (lo == hi and j < i):
                    continue
                sums = pair_sums(a, b, ma, ma if i == j else b.matrices(widths))
                if sums is None:
                    continue
                n, m, *others = sums
                shared = n > 0 if i != j or (both and alone) else np.triu(n > 0)
                at = np.nonzero(shared)
                sym_a, sym_b = a.names.take(pa.array(at[0])), b.names.take(pa.array(at[1]))
                told = {"n": pa.array(n[at].astype(np.int64))}
                if alone:
                    told["corr"] = pa.array(pearson(m, *others[2:7])[at])
                else:
                    told |= {c: pa.array(s[at]) for c, s in zip(_SUMS, (m, *others))}
                yield pa.RecordBatch.from_pydict({"sym_a": sym_a, "sym_b": sym_b, **told})
                if both and alone and i != j:
                    yield pa.RecordBatch.from_pydict({"sym_a": sym_b, "sym_b": sym_a, **told})

    schema = f"sym_a {kind}, sym_b {kind}, n long, " + ("corr double" if alone else ", ".join(f"{c} double" for c in _SUMS))
    parts = _sent(values, blocks, strips, positions).groupBy("lo", "hi", "part").applyInArrow(multiply, schema)
    # Blocks are in order of hashes; a pair is told with its smaller symbol first.
    turned, swap = F.col("sym_a") > F.col("sym_b"), {"sx": "sy", "sy": "sx", "cxx": "cyy", "cyy": "cxx", "bxx": "byy", "byy": "bxx"}
    ordered = F.least("sym_a", "sym_b").alias("sym_a"), F.greatest("sym_a", "sym_b").alias("sym_b")
    if alone:
        return parts if both else parts.select(*ordered, "n", "corr")
    parts = parts.select(*ordered, "n", *(F.when(turned, F.col(swap.get(c, c))).otherwise(F.col(c)).alias(c) for c in _SUMS))
    added = parts.groupBy("sym_a", "sym_b").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    moments = added.withColumns({"vx": _moment("cxx", "bxx", "sx", "sx"), "vy": _moment("cyy", "byy", "sy", "sy"), "co": _moment("cxy", "bxy", "sx", "sy")})
    varies = (F.col("m") >= 2) & (F.col("vx") > LEAST_VARIANCE * (F.col("cxx") + F.col("bxx"))) & (F.col("vy") > LEAST_VARIANCE * (F.col("cyy") + F.col("byy")))
    found = moments.select("sym_a", "sym_b", "n", F.when(varies, F.try_divide("co", F.sqrt("vx") * F.sqrt("vy"))).otherwise(0.0).alias("corr"))
    if not both:
        return found
    pairs = F.when(F.col("sym_a") == F.col("sym_b"), F.array(F.struct("sym_a", "sym_b"))).otherwise(F.array(F.struct("sym_a", "sym_b"), F.struct(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b"))))
    return found.select(F.explode(pairs).alias("p"), "n", "corr").select("p.*", "n", "corr")
