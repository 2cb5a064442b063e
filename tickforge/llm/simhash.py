"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code on 64 bits: the bits are cut into blocks and an anchor is
constant in each block (a product of repetition codes, so a fingerprint's nearest anchor is the majority
bit of each block). A fingerprint's home is its nearest anchor, which is within the code's covering radius.
A fingerprint is copied to each anchor that is home to any point within the threshold of it, in other words
to the anchors within covering radius plus threshold that can matter. Two fingerprints within the threshold
so meet at the home of either, and each anchor compares its homes with its copies.

Cost: N fingerprints make N * c copies (c is 30 to 300 by the number of blocks) and N * N * c / 2^blocks
comparisons of one XOR and popcount; the number of blocks grows with log2(N) / 2 to balance both.
Copies of a fingerprint are collapsed beforehand, so exact copies cost nothing here. An anchor with many
fingerprints is cut into cells of bounded size, each a task group of its own.

Nulls and edge cases: a null or empty text has fingerprint 0 and is linked like any other; extra columns
stay out of the result; repeated rows get the same answer; an empty table gives an empty result; a null
doc_id is never a component's name unless all its documents lack one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ranges, save, shuffle_partitions

BITS = 64
CELL_HOMES, CELL_COPIES = 8192, 32768


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(first, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row a document, fp as a signed long."""

    def work(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


def blocks_for(n: int) -> int:
    return max(8, min(16, round(np.log2(max(n, 2)) / 2)))


def anchor_copies(fps: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each copy; the first len(fps) are the homes."""
    bounds = np.linspace(0, BITS, blocks + 1).astype(int)
    home = np.zeros(len(fps), np.int64)
    margins = np.empty((blocks, len(fps)), np.int8)  # flips that change a block's majority
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        ones = np.bitwise_count(fps >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int8)
        half = (hi - lo) // 2
        one = ones > half
        home |= one.astype(np.int64) << i
        margins[i] = np.where(one, ones - half, half + 1 - ones)
    rows, anchors = [np.arange(len(fps))], [home]
    for k in range(1, min(threshold, blocks) + 1):
        for chosen in combinations(range(blocks), k):
            near = np.flatnonzero(margins[list(chosen)].sum(axis=0) <= threshold)
            rows.append(near)
            anchors.append(home[near] ^ sum(1 << i for i in chosen))
    return np.concatenate(rows), np.concatenate(anchors)


def forest(homes: np.ndarray, copies: np.ndarray, threshold: int) -> np.ndarray:
    """Links of a spanning forest of the pairs within the threshold: rows (greater, smallest of its tree)."""
    nodes, where = np.unique(np.concatenate([homes, copies]), return_inverse=True)
    at, to = where[: len(homes)], where[len(homes) :]
    label = np.arange(len(nodes))
    links = []
    step = max(1, (4 << 20) // max(len(copies), 1))
    for i in range(0, len(homes), step):
        x, y = np.nonzero(np.bitwise_count(homes[i : i + step, None] ^ copies[None, :]) <= threshold)
        x, y = at[i + x], to[y]
        links.append(np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1)[x != y], axis=0))
    links = np.concatenate(links)
    while len(links):  # labels go down to the smallest of each tree
        a, b = label[links[:, 0]], label[links[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)


def links(nodes: DataFrame, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v), u > v: links whose components are those of all pairs of `nodes`.fp within the threshold.

    A row that is shuffled holds all fingerprints of a batch that go to one cell, 8 bytes each.
    """
    spark = nodes.sparkSession
    blocks = blocks or blocks_for(nodes.count())
    nodes = nodes.select("fp").repartition(4 * shuffle_partitions(spark))

    def by_anchor(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 8192):
                part = fps[i : i + 8192]
                rows, anchors = anchor_copies(part.view(np.uint64), blocks, threshold)
                yield part, rows, anchors

    def count(batches):
        homes, copies = np.zeros(1 << blocks, np.int64), np.zeros(1 << blocks, np.int64)
        for part, rows, anchors in by_anchor(batches):
            homes += np.bincount(anchors[: len(part)], minlength=len(homes))
            copies += np.bincount(anchors, minlength=len(copies))
        used = np.flatnonzero(copies)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(homes[used]), pa.array(copies[used])], names=["anchor", "homes", "copies"])

    # At most 2^blocks <= 65,536 anchors: what the driver takes is bounded whatever the input.
    sizes = nodes.mapInArrow(count, "anchor long, homes long, copies long").groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("copies").alias("copies"))
    parts = np.ones((2, 1 << blocks), np.int64)
    for r in sizes.where((F.col("homes") > CELL_HOMES) | (F.col("copies") > CELL_COPIES)).collect():
        parts[:, r.anchor] = -(-r.homes // CELL_HOMES), -(-r.copies // CELL_COPIES)
    held = spark.sparkContext.broadcast(parts)

    def copy(batches):
        p, q = held.value
        for part, rows, anchors in by_anchor(batches):
            salt = mix(part.view(np.uint64))
            for home in (True, False):  # homes go to one i and every j, copies to every i and one j
                r, a = (rows[: len(part)], anchors[: len(part)]) if home else (rows, anchors)
                own, every = (p, q) if home else (q, p)
                times = every[a]
                r, a, other = np.repeat(r, times), np.repeat(a, times), ranges(np.zeros(len(a), np.int64), times)
                mine = (salt[r] % own[a].astype(np.uint64)).astype(np.int64)
                i, j = (mine, other) if home else (other, mine)
                cell = a << 40 | i << 20 | j
                order = np.argsort(cell, kind="stable")
                cell, fps = cell[order], part[r[order]]
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                blobs = [fps[x:y].tobytes() for x, y in zip(first, np.append(first[1:], len(cell)))]
                yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array([home] * len(first)), pa.array(blobs, pa.binary())], names=["cell", "home", "fps"])

    def compare(cell: pa.Table) -> pa.Table:
        home = cell.column("home").to_numpy()
        blobs = cell.column("fps").to_pylist()
        sides = [np.frombuffer(b"".join(x for x, h in zip(blobs, home) if h == side), np.uint64) for side in (True, False)]
        found = forest(*sides, threshold) if len(sides[0]) else np.zeros((0, 2), np.uint64)
        found = np.ascontiguousarray(found.T).view(np.int64)
        return pa.table({"u": found[0], "v": found[1]})

    cells = nodes.mapInArrow(copy, "cell long, home boolean, fps binary")
    return cells.groupBy("cell").applyInArrow(compare, "u long, v long").distinct()


def stars(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v): every node that has an edge but isn't the smallest of its component, and the smallest.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    """
    edges = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        edges = save(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges"
        )
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `threshold` differing bits."""
    prints = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = save(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = stars(links(nodes, threshold, blocks)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.join(named, "root").select("fp", "component"), "fp").select(id_col, "fp", "component")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """The documents without those that have a near copy with a smaller doc_id in their component."""
    gone = components(docs, threshold=threshold).where("component < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
