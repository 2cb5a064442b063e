"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

The index is a table of segments. A segment covers a run of documents (about `SEGMENT_WORDS` words; a longer
document has a segment of its own) and holds, for each of its terms, the sorted places where it stands. Places
count on over the segment's documents with a gap between them, so that no match reaches over two documents.
Each executor writes the segments of the rows it reads: no text and no token is shuffled. All training tokens are
indexed, whatever the test set; `build_index` writes an index, and `search` asks one as often as wanted.

The test windows are a table as well, dealt into blocks of at most about `BLOCK_WINDOWS`; each block is broadcast, asked of all
segments, and let go, and what it finds is stored by the row's segment and number in it. In a segment, a window's lists are
intersected from its rarest term on: the list of the rarest, less the term's offset, gives the starts that are possible, and each
next list, less its own offset, cuts them down. With slop > 0 a term may stand up to `slop` words off its place
(proximity matches); with 0 matches are exact phrases.

Nulls and edge cases: a null text has no words; an item without words has no window, one of fewer words than a
window is one window; extra columns stay out; each row of documents is judged by its own text and comes back once, with
or without a doc_id and however many blocks the test set takes; repeated items count once; empty tables give no hits or
no rows; a null item_id is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, fresh, hash_words, new_path, save, split_words, text_runs

SEGMENT_WORDS = 1 << 19
#: Test windows that a pass over the index takes, some 90 bytes each: what is broadcast is bounded by it.
BLOCK_WINDOWS = 1 << 18
SEGMENT = "segment long, docs binary, known binary, bases binary, n_words binary, terms binary, ends binary, places binary"


def hashed(texts: pa.Array):
    """(first row, row offsets in words, word hashes) for runs of texts."""
    for i, j, data, offsets in text_runs(texts):
        data = LOWER[data]
        starts, ends, first = split_words(data, offsets, ALNUM)
        yield i, j, first, hash_words(data, starts, ends)


WINDOWS = "item string, n int, words binary"


def test_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, words): the windows of each item, as hashes of their n words padded with 0; those that recur in a row count once."""

    def work(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, first, words in hashed(b.column(1)):
                for k in range(i, j):
                    own = words[first[k - i] : first[k - i + 1]]
                    if len(own):
                        n = min(window, len(own))
                        grams = np.pad(np.unique(np.lib.stride_tricks.sliding_window_view(own, n), axis=0), ((0, 0), (0, window - n)))
                        yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["item", "n", "words"])

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(work, WINDOWS)


def segments(batches, gap: int):
    """Index rows for (id, text) batches."""
    ids, known, bases, counts, all_words, all_places = [], [], [], [], [], []
    base, number = 0, TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def flush():
        t, p = np.concatenate(all_words), np.concatenate(all_places)
        order = np.argsort(t, kind="stable")
        t = t[order]
        ends = np.flatnonzero(np.append(t[1:] != t[:-1], True)[: len(t)]) + 1
        blobs = [np.asarray(ids, np.int64), np.asarray(known, bool), np.asarray(bases, np.int64), np.asarray(counts, np.int64), t[ends - 1], ends.astype(np.int64), p[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in blobs], names=[x.split()[0] for x in SEGMENT.split(", ")])

    for b in batches:
        names, given = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False), b.column(0).is_valid().to_numpy(zero_copy_only=False)
        for i, j, first, words in hashed(b.column(1)):
            own = base + first[:-1] + gap * np.arange(j - i)
            all_words.append(words)
            all_places.append((np.repeat(own - first[:-1], np.diff(first)) + np.arange(len(words))).astype(np.int64))
            ids += names[i:j].tolist()
            known += given[i:j].tolist()
            bases += own.tolist()
            counts += np.diff(first).tolist()
            base = int(own[-1] + np.diff(first)[-1] + gap)
            if base >= SEGMENT_WORDS:
                yield flush()
                ids, known, bases, counts, all_words, all_places, base, number = [], [], [], [], [], [], 0, number + 1
    if ids:
        yield flush()


def build_index(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the index of docs and returns its path; gap: words kept free between documents, at least a window and twice the slop."""
    path = new_path(docs.sparkSession, "index")
    docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lambda batches: segments(batches, gap), SEGMENT).write.option("compression", "zstd").parquet(path)
    return path


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of wanted have one of the sorted places within slop."""
    at = np.searchsorted(places, wanted - slop)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= wanted + slop)


def intersect(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, windows: np.ndarray, lengths: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every match in one segment."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    at = np.searchsorted(terms, windows)
    at[at == len(terms)] = 0
    real = np.arange(windows.shape[1])[None, :] < lengths[:, None]
    known = (terms[at] == windows) | ~real
    live = np.flatnonzero(known.all(axis=1))
    size = np.where(real[live], (ends - begins)[at[live]], np.iinfo(np.int64).max)
    order = np.argsort(size, axis=1, kind="stable")
    found_w, found_s = [], []
    # Windows in runs whose rarest lists hold about a million places together.
    rarest = np.take_along_axis(size, order[:, :1], 1)[:, 0]
    cuts = np.cumsum(rarest) // (1 << 20)
    for run in np.split(np.arange(len(live)), np.flatnonzero(np.diff(cuts)) + 1) if len(live) else []:
        which = live[run]
        rank = order[run]
        lead = at[which, rank[:, 0]]
        counts = (ends - begins)[lead]
        start = places[np.concatenate([np.arange(b, b + n) for b, n in zip(begins[lead], counts)])] - np.repeat(rank[:, 0], counts) if len(lead) else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(which)), counts)
        for k in range(1, windows.shape[1]):
            if not len(who):
                break
            offset = rank[who, k]
            needed = offset < lengths[which[who]]
            term = at[which[who], offset]
            ok = ~needed
            by = np.argsort(term, kind="stable")
            by = by[needed[by]]
            for group in np.split(by, np.flatnonzero(np.diff(term[by])) + 1):
                if len(group):
                    t = term[group[0]]
                    ok[group] = _near(places[begins[t] : ends[t]], start[group] + offset[group], slop)
            who, start = who[ok], start[ok]
        found_w.append(which[who])
        found_s.append(start)
    return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search_segment(row: dict[str, bytes], windows: np.ndarray, lengths: np.ndarray, slop: int) -> np.ndarray:
    """Matches as (document's number, start, length, window)."""
    bases, counts, ends = (np.frombuffer(row[k], np.int64) for k in ("bases", "n_words", "ends"))
    terms, places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["places"], np.int32)
    if not len(terms) or not len(windows):
        return np.zeros((0, 4), np.int64)
    w, s = intersect(terms, ends, places, windows, lengths, slop)
    d = np.searchsorted(bases, s + slop, "right") - 1
    matches = np.stack([d, s - bases[d], lengths[w], w], 1)
    return matches[(matches[:, 1] >= -slop) & (matches[:, 1] + matches[:, 2] <= counts[d] + slop)]


def search(spark: SparkSession, path: str, windows: DataFrame, window: int, slop: int = 0) -> DataFrame:
    """(segment, number, hits array of (start, length), items array): the rows of an index in which a window of (item, n, words) occurs."""
    windows = save(windows, "windows")
    blocks = -(-windows.count() // BLOCK_WINDOWS)
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1))))
    index = spark.read.schema(SEGMENT).parquet(path).select("segment", "bases", "n_words", "terms", "ends", "places")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    found = spark.createDataFrame([], "segment long, number long, hits array<struct<start:long,length:long>>, items array<string>")
    for k in range(blocks):
        block = dealt.where(F.col("block") == k).drop("block").toPandas()  # about BLOCK_WINDOWS rows
        grams = np.frombuffer(b"".join(map(bytes, block["words"])), np.uint64).reshape(-1, window)
        held = spark.sparkContext.broadcast((block["item"].to_numpy(object), block["n"].to_numpy(np.int64), grams))

        def ask(batches, held=held):
            items, lengths, grams = held.value
            for b in batches:
                for row in b.to_pylist():
                    got = search_segment(row, grams, lengths, slop)
                    got = got[np.argsort(got[:, 0], kind="stable")]
                    numbers, first = np.unique(got[:, 0], return_index=True)
                    parts = np.split(got, first[1:])
                    hits = [[{"start": int(s), "length": int(n)} for s, n in np.unique(part[:, 1:3], axis=0)] for part in parts if len(part)]
                    own = [sorted(set(items[part[:, 3]])) for part in parts if len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(hits, kind), pa.array(own, pa.list_(pa.string()))], names=["segment", "number", "hits", "items"])

        found = found.unionByName(save(index.mapInArrow(ask, ", ".join(f"{c} {t}" for c, t in found.dtypes)), "found"))
        held.destroy()
    # A group is one row of docs in each block of test windows.
    grouped = found.groupBy("segment", "number").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return grouped.select("segment", "number", F.array_sort(F.array_distinct("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """(segment, number, id, n_words): the rows of docs in an index; only those columns are read."""

    def work(batches):
        for b in batches:
            for segment, docs, known, counts in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(docs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids, mask=~np.frombuffer(known, bool)), pa.array(np.frombuffer(counts, np.int64))], names=["segment", "number", "id", "n_words"])

    return spark.read.schema(SEGMENT).parquet(path).select("segment", "docs", "known", "n_words").mapInArrow(work, "segment long, number long, id long, n_words long")


def spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, hits array of (start, length), items array): one row a row of docs, hits in order of their starts."""
    spark = docs.sparkSession
    path = build_index(docs, window + 2 * slop, id_col, text_col)
    found = search(spark, path, test_windows(benchmark, window, item_col, item_text), window, slop)
    none = {c: F.coalesce(c, F.array().cast(dict(found.dtypes)[c])) for c in ("hits", "items")}
    return rows_of(spark, path).join(found, ["segment", "number"], "left").withColumns(none).select(F.col("id").alias(id_col), "n_words", "hits", "items")


def covered(hits, n_words: int) -> int:
    """Words inside any of the hits."""
    total, reach = 0, 0
    for h in hits:  # sorted by start
        a, b = max(h["start"], reach, 0), min(h["start"] + h["length"], n_words)
        if b > a:
            total += b - a
            reach = b
    return total


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    def digest(batches):
        for b in batches:
            counts = b.column(1).to_pylist()
            hit = [covered(h, n) for h, n in zip(b.column(2).to_pylist(), counts)]
            items = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows in whose text any test window occurs."""
    row = fresh(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))  # repeated rows share it, other texts of a doc_id, or of none, don't
    gone = spans(marked, benchmark, window, id_col=row).where(F.size("hits") > 0).select(row).distinct()
    return marked.join(gone, row, "left_anti").select(docs.columns)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
