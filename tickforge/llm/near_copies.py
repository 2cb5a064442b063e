"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least `SIMILARITY`.

Candidates come from two searches. SimHash (operator 2, anchor-point covering) on fingerprints of the same shingles links
documents within `BITS` bits. But documents at similarity 0.8 differ in 10 of 64 bits on average and in up to 19, and so do too many
strangers for a search whose cost isn't quadratic; so MinHash takes the rest: a document has `BANDS` keys of `ROWS` minima each, and
documents with a key in common are a group. Two documents at similarity s have none in common with chance (1 - s^ROWS)^BANDS: 3 in
a million at 0.8, less above.
No candidate is believed: in each group the shingle sets themselves are compared. Groups that recur over the keys are
compared once; they are told apart by aggregates, not by lists. A group of over `CHUNK` members is compared in chunks that share its
smallest member, then chunk against chunk, without pairs of chunks that are of one component by then. Of groups of over `LARGE`
members, as documents of one template make without being copies, only members that share one of `FINE_BANDS` keys of `FINE_ROWS` further
minima go on together: strangers that share half their shingles meet in one pair of 250 for each key, and pairs at 0.8 are missed with
chance 4 in 10 million.

Documents with the same set are one node, so exact copies cost nothing; only sets of nodes in groups are shuffled.

Nulls and edge cases: a text of fewer words than a shingle is one shingle; texts without words are copies of each
other; repeated rows stay or go together, other texts of the same doc_id are judged by themselves; a row without a
doc_id stays, and names a component only if none of its documents has one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, SPACED, fresh, hash_windows, hash_words, heavy, join_spread, mix, save, shuffle_partitions, split_words, text_runs
from .simhash import stars

SIMILARITY, SHINGLE, BITS, BANDS, ROWS, CHUNK = 0.8, 5, 4, 24, 4, 256
#: What a group is split by before its chunks are paired: LARGE is sixteen chunks, so up to there a member is in at most sixteen pairs.
LARGE, FINE_BANDS, FINE_ROWS = 16 * CHUNK, 80, 8
_RNG = np.random.Generator(np.random.PCG64(20240301))
_ODD = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

_FINE_ODD = _RNG.integers(0, 1 << 31, FINE_BANDS * FINE_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_MULTIPLIERS = _RNG.integers(0, 1 << 63, (FINE_BANDS, FINE_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

def shingle_sets(texts: pa.Array, shingle: int = SHINGLE):
    """(first row, end row, hashes, offsets) for runs of texts: each row's distinct shingle hashes, sorted."""
    for i, j, data, offsets in text_runs(texts):
        data = LOWER[data]
        starts, ends, first = split_words(data, offsets, SPACED)
        words = hash_words(data, starts, ends)
        windows = hash_windows(words, shingle)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            sets.append(np.unique(windows[a : b - shingle + 1] if b - a >= shingle else hash_windows(words[a:b], b - a) if b > a else words[:0]))
        yield i, j, np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets]))


def band_keys(hashes: np.ndarray, offsets: np.ndarray, odds: np.ndarray = _ODD, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """(rows, bands) keys as signed longs, each of as many minima as multipliers has columns; every row must have a hash."""
    bands, rows = multipliers.shape
    x, keys = (hashes >> np.uint64(32)).astype(np.uint32), np.zeros((len(offsets) - 1, bands), np.uint64)
    for k, odd in enumerate(odds):
        low = np.minimum.reduceat(x * odd, offsets[:-1]).astype(np.uint64)
        keys[:, k // rows] += (low + np.uint64(k + 1)) * multipliers[k // rows, k % rows]
    keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def set_fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of sets of hashes, as signed longs; every row must have a hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, offsets[:-1], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(offsets)[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def compare(sets: list[np.ndarray], labels: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (i, j) that join the labels of all sets with a similar pair; pairs within a label aren't looked at."""
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    universe, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, links = np.zeros(len(universe), bool), np.unique(labels, return_inverse=True)[1], []
    for i in range(len(sets)):
        if (label == label[0]).all():
            break
        if (label[i + 1 :] == label[i]).all():
            continue
        own = at[begins[i] : begins[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[at], begins, dtype=np.int64)
        mark[own] = False
        near = (both >= similarity * (sizes + sizes[i] - both) - 1e-9) & (np.arange(len(sets)) > i)
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _row(docs: DataFrame, id_col: str, text_col: str) -> F.Column:
    """128 bits that name a row by its id and text; nulls differ from empty ones."""
    told = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.md5(F.concat(told[0], F.lit("\n"), told[1]).cast("binary"))


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(row, id, node, keys, fp): row is a hash of id and text, node one of the shingle set."""

    def work(batches):
        for b in batches:
            nodes, keys, fps = [], [], []
            for i, j, hashes, offsets in shingle_sets(b.column(2), shingle):
                nodes += [xxhash.xxh64_intdigest(hashes[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:])]
                filled = np.flatnonzero(np.diff(offsets))
                own, fp = np.zeros((j - i, BANDS), np.int64), np.zeros(j - i, np.int64)
                if len(filled):
                    at = np.append(offsets[:-1][filled], offsets[-1])
                    own[filled], fp[filled] = band_keys(hashes, at), set_fingerprints(hashes, at)
                fps.append(fp)
                keys += [x.tobytes() if n else None for x, n in zip(own, np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64))], names=["row", "id", "node", "keys", "fp"])

    return docs.select(_row(docs, id_col, text_col), id_col, text_col).mapInArrow(work, f"row string, id {dict(docs.dtypes)[id_col]}, node long, keys binary, fp long")


def groups(nodes: DataFrame) -> DataFrame:
    """(g, node, least, n): nodes that have a MinHash key in common or a SimHash component, those of equal groups once; n members, least the smallest."""

    def spread(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "node"])

    filled = nodes.where("keys is not null")
    linked = stars(simhash.links(save(filled.select("fp").distinct(), "fingerprints"), BITS)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    near = filled.select("node", "fp").join(linked, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node")
    keyed = save(filled.select("node", "keys").mapInArrow(spread, "key long, node long").unionByName(near).distinct(), "keyed")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), *marks).where("n > 1")
    once = save(found.groupBy("n", "least", "x0", "x1").agg(F.min("key").alias("key")).select("key", "least", "n"), "once")
    return join_spread(keyed, once, "key", heavy(once.select("key", "n"), "key"), ["node"]).withColumnRenamed("key", "g")


def similar(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that join all similar pairs of nodes within a cell; cells: (cell, node, label)."""

    def work(cell: pa.Table) -> pa.Table:
        nodes = cell.column("node").to_numpy()
        found = compare([np.frombuffer(x.as_py(), np.uint64) for x in cell.column("hashes")], cell.column("label").to_numpy(), similarity)
        return pa.table({"u": pa.array([nodes[i] for i, _ in found], pa.int64()), "v": pa.array([nodes[j] for _, j in found], pa.int64())})

    return cells.join(sets, "node").groupBy("cell").applyInArrow(work, "u long, v long")


def split_groups(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, n, node, label): groups (g, node, label) by finer keys, without those of one label; a member is in up to FINE_BANDS of them."""

    def keyed(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                lists = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                keys = band_keys(np.concatenate(lists), np.append(0, np.cumsum([len(x) for x in lists])), _FINE_ODD, _FINE_MULTIPLIERS).view(np.uint64)
                g = mix(part.column(0).to_numpy().view(np.uint64)[:, None] + np.arange(1, FINE_BANDS + 1, dtype=np.uint64))
                cells = mix(keys ^ g).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(np.repeat(part.column(k).to_numpy(), FINE_BANDS)) for k in (1, 2))], names=["g", "node", "label"])

    found = save(large.join(sets, "node").select("g", "node", "label", "hashes").mapInArrow(keyed, "g long, node long, label long"), "fine")
    open_ = save(found.groupBy("g").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("g", "n"), "open")
    return join_spread(found, open_, "g", heavy(open_, "g"), ["node"]).select("g", "n", "node", "label")


def chunk_cells(labelled: DataFrame) -> DataFrame:
    """(cell, node, label): a cell for each two chunks of a group, and each one, that aren't of one label; labelled: (g, n, node, label), n the group's size.

    Members are in the order of their labels, numbered by ranges of rows, so that a group of any size is many tasks.
    """
    order = ["label", "node"]
    tasks = 4 * shuffle_partitions(labelled.sparkSession)
    labelled = save(labelled, "labelled")  # ranges are sampled from what is there already
    ranged = save(labelled.repartitionByRange(tasks, "g", *order).withColumn("p", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most `tasks` rows a group
    bases = ranged.groupBy("g", "p").agg(F.count("*").alias("m")).select("g", "p", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("g", "p").orderBy(*order)) - 1
    placed = save(ranged.join(bases, ["g", "p"]).select("g", "n", F.floor(place / CHUNK).alias("x"), *order), "chunks")
    chunks = placed.groupBy("g", "n", "x").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    last = F.expr(f"cast(ceil(n / {CHUNK}) as bigint) - 1")
    pairs = chunks.select("g", "x", "least", F.explode(F.sequence("x", last)).alias("y")).join(chunks.select("g", F.col("x").alias("y"), "most"), ["g", "y"])
    cells = pairs.where("least <> most").select("g", F.xxhash64("g", "x", "y").alias("cell"), F.explode(F.array_distinct(F.array("x", "y"))).alias("x"))
    return cells.join(placed, ["g", "x"]).select("cell", "node", "label")


def links(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links whose components are those of all similar pairs in a group."""
    rest = F.expr(f"cast(ceil((n - 1) / {CHUNK}) as int)")
    first = found.where("node <> least").select("g", "node", F.pmod(F.xxhash64("node"), rest).cast("int").alias("c"))
    pivots = found.where("node = least").select("g", "node", F.explode(F.sequence(F.lit(0), rest - 1)).alias("c"))
    near = save(similar(first.unionByName(pivots).select(F.xxhash64("g", "c").alias("cell"), "node", F.col("node").alias("label")), sets, similarity).distinct(), "near")
    large = found.where(F.col("n") > CHUNK + 1).select("g", "n", "node")
    if large.isEmpty():
        return near
    roots = stars(near)
    labelled = large.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("g", "n", "node", F.coalesce("root", "node").alias("label"))

    # Groups that the first chunks have joined already, as a group of true copies is, go no further.
    open_ = labelled.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("g")
    apart = save(labelled.join(open_, "g", "left_semi"), "apart")
    larger = apart.where(F.col("n") > LARGE)
    if not larger.isEmpty():
        apart = apart.where(F.col("n") <= LARGE).unionByName(split_groups(larger, sets))
    return near.unionByName(similar(chunk_cells(apart), sets, similarity)).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, id, component): component is the smallest id reachable over links of similar documents."""
    marked = save(prints(docs, id_col, text_col, shingle), "prints")
    nodes = save(marked.groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    found = save(groups(nodes), "groups")
    wanted = found.select("node").distinct().join(nodes.select("node", "row"), "node").select("row")
    texts = docs.select(_row(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(wanted, "row", "left_semi")

    def hashed(batches):
        for b in batches:
            for _, _, hashes, offsets in shingle_sets(b.column(0), shingle):
                blobs = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
                ids = np.array([xxhash.xxh64_intdigest(x) for x in blobs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], names=["node", "hashes"])

    sets = save(texts.dropDuplicates(["row"]).select("text").mapInArrow(hashed, "node long, hashes binary"), "sets")
    roots = stars(links(found, sets, similarity)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(rooted.join(named, "root").select("node", "component"), "node").select("row", "id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component."""
    row = fresh(docs, "_row")
    gone = components(docs, id_col, text_col, shingle, similarity).where("component < id").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, _row(docs, id_col, text_col)).join(gone, row, "left_anti").select(docs.columns)
