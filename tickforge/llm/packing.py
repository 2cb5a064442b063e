"""Lexical retrieval packing: windows of seed documents filled with their BM25 neighbours.

Documents become token ids. As many full windows as a document has leave as sequences of their own; what remains
of it, less than a window, is packed. Document frequencies and mean length are counted over whole documents.

Remainders are dealt so that lexical neighbours meet: a sample gives the main axes of the BM25-weighted tokens and a
tree that cuts along them into leaves of about `SHARD` remainders; a leaf of over half as much again is dealt by
rows' places in the saved table, equal rows too. Each shard has an inverted index of its own over its remainders' tokens, weighted by BM25.
In a shard, the first unused remainder is the seed of a new window. All its ids give each unused remainder a score;
down the full order of scores, those that fit are taken. What space is left, less than any unused remainder, is
filled by cutting the best one, whose rest stays unused. So every window but the last of a shard is full. Neighbours
in other shards aren't seen: README says how many of the true ones meet.

Nulls and edge cases: a null or empty text is its end token alone; extra columns stay out; repeated rows are
packed each; a row without a doc_id is packed too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, save
from .tokens import default_path, encoded, small_batches

WINDOW, SHARD = 2048, 2048
#: Of the tree that deals remainders: latent axes, remainders they are fitted to, sampled remainders a leaf and in all.
AXES, LATENT, LEAF_SAMPLE, SAMPLE = 32, 4096, 64, 1 << 15
K1, B = 1.2, 0.75
#: BM25 weights are whole numbers of steps, so that sums are exact in any order, and the numbers small.
STEPS = 4096


def crc(ids: bytes, dtype: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str, kind: str, end_id: int, vocab: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, crc, ids): full windows (crc, no ids), remainders (ids as 4- or 2-byte integers),
    and a row of length -1 a task, whose ids are pairs (token, whole documents that hold it) as 8-byte integers."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches):
        df, documents, total, tails, own = np.zeros(vocab, np.int64), 0, 0, 0, None
        for b in small_batches(batches):
            rows = []
            for i, ids, dtype in encoded(b.column(1).cast(pa.binary()), path, kind, end_id):
                n, w = len(ids) // dtype.itemsize, dtype.itemsize
                df[np.frombuffer(ids, dtype)] += 1  # once for each distinct id, however often it occurs
                documents += 1
                total += n
                tails += n % window > 0
                for s in range(0, n, window):
                    part = ids[s * w : (s + window) * w]
                    full = len(part) == window * w
                    rows.append((i, s, len(part) // w, n, crc(part, dtype) if full else None, None if full else part))
            cols = list(zip(*rows)) or [()] * 6
            own = b.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own] + [pa.array(c, k) for c, k in zip(cols[1:], kinds[1:])], names=["id", "start", "length", "doc_tokens", "crc", "ids"])
        if documents:
            used = np.flatnonzero(df)
            counts = np.stack([np.append(used, [-3, -2, -1]), np.append(df[used], [tails, total, documents])], 1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, own.type)] + [pa.array([x], k) for x, k in zip((0, -1, 0, None, counts), kinds[1:])], names=["id", "start", "length", "doc_tokens", "crc", "ids"])

    return docs.select(id_col, text_col).mapInArrow(work, f"id {dict(docs.dtypes)[id_col]}, start long, length int, doc_tokens long, crc long, ids binary")


def frequencies(found: DataFrame, vocab: int) -> tuple[np.ndarray, int, float, int]:
    """(documents that hold each id, documents, mean length, remainders), over all of them; at most `vocab` rows reach the driver."""

    def count(batches):
        for b in batches:
            for x in b.column(0):
                pairs = np.frombuffer(x.as_py(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["token", "n"])

    got = {r.token: r.n for r in found.where("length < 0").select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, total, tails = (got.pop(k, 0) for k in (-1, -2, -3))
    df = np.zeros(vocab, np.int64)
    df[list(got)] = list(got.values())
    return df, n, total / max(n, 1), tails


class Dealer:
    """A tree over remainders' directions in a small latent space, fitted to a sample: neighbours come to the same leaf."""

    def __init__(self, sample: list[np.ndarray], df: np.ndarray, n: int, leaves: int):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        rng = np.random.default_rng(42)
        self.axes = rng.standard_normal((len(df), AXES), np.float32)
        held = [self.weights(x) for x in sample[:LATENT]]
        for _ in range(2):  # power iterations towards the main axes of the sample
            q = np.linalg.qr(np.stack([w @ self.axes[t] for t, w in held]))[0]
            axes = np.zeros((len(df), q.shape[1]), np.float32)
            for (t, w), row in zip(held, q.astype(np.float32)):
                axes[t] += w[:, None] * row
            self.axes = axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-9)
        points = np.stack([self.point(x) for x in sample])
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._split(points, leaves)

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, tf = np.unique(ids, return_counts=True)
        w = self.idf[t] * (tf * (K1 + 1) / (tf + K1)).astype(np.float32)
        return t, w / max(np.linalg.norm(w), 1e-9)

    def point(self, ids: np.ndarray) -> np.ndarray:
        t, w = self.weights(ids)
        x = w @ self.axes[t]
        return x / max(np.linalg.norm(x), 1e-9)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        left = leaves // 2
        if leaves > 1 and len(points) > 1:
            axis = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)[2][0]
            along = points @ axis
            cut = np.quantile(along, left / leaves)
            low = along <= cut
            if 0 < low.sum() < len(points):
                self.nodes[at] = (axis, cut, self._split(points[low], left), self._split(points[~low], leaves - left))
                return at
        self.nodes[at] = (self.leaves,)
        self.leaves += 1
        return at

    def leaf(self, ids: np.ndarray) -> int:
        x, node = self.point(ids), self.nodes[0]
        while len(node) > 1:
            node = self.nodes[node[2] if x @ node[0] <= node[1] else node[3]]
        return node[0]


class Shard:
    """An inverted index over remainders: for each id, the remainders that hold it and their BM25 weights."""

    def __init__(self, ids: list[np.ndarray], df: np.ndarray, n: int, mean: float):
        tokens, rows, counts = [], [], []
        for i, x in enumerate(ids):
            x = np.sort(x, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            tokens.append(x[first])
            counts.append(np.diff(np.append(first, len(x))))
            rows.append(np.full(len(first), i, np.int32))
        token, tf, row = np.concatenate(tokens).astype(np.int64), np.concatenate(counts), np.concatenate(rows)
        lengths = np.array([len(x) for x in ids])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = np.rint(STEPS * idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))).astype(np.int32)
        self.size = np.append(0, np.cumsum([len(t) for t in tokens]))
        self.own = token
        order = np.argsort(token, kind="stable")
        self.rows, self.weights = row[order], weight[order]
        self.ends = np.cumsum(np.bincount(token, minlength=len(df)))
        self.begins = np.append(0, self.ends[:-1])
        self.n = len(ids)
        # Lists that hold an eighth of all remainders and more are rows of a matrix.
        common = np.flatnonzero(self.ends - self.begins > max(1, self.n // 8))
        self.line = np.full(len(df), -1)
        self.line[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.int32)
        for k, t in enumerate(common.tolist()):
            own = slice(self.begins[t], self.ends[t])
            self.dense[k, self.rows[own]] = self.weights[own]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each remainder for all ids of the seed, in steps of 1 / STEPS."""
        token = self.own[self.size[seed] : self.size[seed + 1]]
        line = self.line[token]
        rare = token[line < 0]
        at = ranges(self.begins[rare], self.ends[rare] - self.begins[rare])
        return np.bincount(self.rows[at], self.weights[at], self.n) + self.dense[line[line >= 0]].sum(axis=0, dtype=np.int32)


def fill(ids: list[np.ndarray], index: Shard, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (remainder, first id, length)."""
    lengths = np.array([len(x) for x in ids])
    begin, left = np.zeros(len(ids), np.int64), lengths.copy()
    out, seed = [], 0
    while True:
        while seed < len(ids) and not left[seed]:
            seed += 1
        if seed == len(ids):
            return out
        window_of, space = [(seed, int(begin[seed]), int(left[seed]))], window - int(left[seed])
        begin[seed] += left[seed]
        left[seed] = 0
        if space:
            score = index.scores(seed)
            near = np.flatnonzero((left > 0) & (left <= space))
            while space and len(near):  # what doesn't fit now never will, so the best that fits is the next down the order
                r = int(near[score[near].argmax()])
                n = int(left[r])
                window_of.append((r, int(begin[r]), n))
                space -= n
                begin[r] += n
                left[r] = 0
                size = left[near]
                near = near[(size > 0) & (size <= space)]
            if space and len(rest := np.flatnonzero(left)):  # all that is left is longer than the space
                r = int(rest[score[rest].argmax()])
                window_of.append((r, int(begin[r]), space))
                begin[r] += space
                left[r] -= space
        out.append(window_of)


def deal(found: DataFrame, df: np.ndarray, n: int, tails: int, shard: int, width: int) -> tuple[DataFrame, int]:
    """found and a column of shards, and their number: a leaf of the tree is a shard, or several of equal parts if it is large."""
    leaves = max(1, -(-tails // shard))
    spread = F.xxhash64("id", "start", "ids", "crc")
    if leaves > 1:
        # Hashes choose the sample: the same rows each time, repeated ones once.
        every = max(1, tails // min(SAMPLE, LEAF_SAMPLE * leaves))
        sample = found.where("ids is not null").withColumn("h", spread).where(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.first("ids").alias("ids")).collect()
        sample.sort(key=lambda r: r.h)
        dealer = found.sparkSession.sparkContext.broadcast(Dealer([np.frombuffer(r.ids, f"<u{width}") for r in sample], df, n, leaves))

        def place(batches):
            for b in batches:
                leaf = [None if x is None else dealer.value.leaf(np.frombuffer(x, f"<u{width}")) for x in b.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

        found = save(found.mapInArrow(place, ", ".join(f"{k} {t}" for k, t in found.dtypes) + ", leaf int"), "dealt")
        sizes = {r.leaf: r["count"] for r in found.where("leaf is not null").groupBy("leaf").count().collect()}
    else:
        found, sizes = found.withColumn("leaf", F.when(F.col("ids").isNotNull(), 0)), {0: tails}
    parts = np.array([max(1, -(-sizes.get(k, 0) // (shard + shard // 2))) for k in range(max(sizes, default=0) + 1)])
    first, shards = np.cumsum(parts) - parts, int(parts.sum())
    table = found.sparkSession.createDataFrame([(k, int(a), int(p)) for k, (a, p) in enumerate(zip(first, parts))], "leaf int, first int, parts int")
    # By a row's place in the saved table, so that equal rows are spread too.
    place_of = F.xxhash64(F.monotonically_increasing_id())
    found = found.withColumn("place", place_of)
    own = F.when(F.col("leaf").isNull(), F.pmod("place", F.lit(shards))).otherwise(F.col("first") + F.pmod("place", F.col("parts")))
    return found.join(F.broadcast(table), "leaf", "left").withColumn("shard", own.cast("long")).drop("leaf", "first", "parts", "place"), shards


def pack(docs: DataFrame, path: str, kind: str, end_id: int, window: int = WINDOW, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece."""
    from .tokens import encoder

    spark = docs.sparkSession
    e = encoder(path, kind)
    vocab, width = max(e.library.get_vocab_size(), end_id + 1), e.dtype.itemsize
    found = save(pieces(docs, path, kind, end_id, vocab, window, id_col, text_col), "pieces")
    *numbers, tails = frequencies(found, vocab)
    held = spark.sparkContext.broadcast(numbers)
    dealt, shards = deal(found.where("length >= 0"), numbers[0], numbers[1], tails, shard, width)

    def pack_shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("start", "ascending")])
        names, start, length, total = (group.column(k).to_pylist() for k in ("id", "start", "length", "doc_tokens"))
        checks, blobs = group.column("crc").to_pylist(), group.column("ids").to_pylist()
        number, base = 0, group.column("shard")[0].as_py()
        rows = []
        for i, blob in enumerate(blobs):
            if blob is None:
                rows.append((names[i], start[i], length[i], checks[i], total[i], base + shards * number, 0))
                number += 1
        tails = [i for i, blob in enumerate(blobs) if blob is not None]
        ids = [np.frombuffer(blobs[i], f"<u{width}") for i in tails]
        if ids:
            for sequence in fill(ids, Shard(ids, *held.value), window):
                at = 0
                for r, a, n in sequence:
                    i = tails[r]
                    rows.append((names[i], start[i] + a, n, zlib.crc32(ids[r][a : a + n].astype("<u4").tobytes()), total[i], base + shards * number, at))
                    at += n
                number += 1
        cols = list(zip(*rows))
        return pa.table([pa.array(cols[0], group.column("id").type)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind_of = dict(docs.dtypes)[id_col]
    return dealt.groupBy("shard").applyInArrow(pack_shard, f"{id_col} {kind_of}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, default_path("byte_bpe_50k.json"), "byte", 1)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
