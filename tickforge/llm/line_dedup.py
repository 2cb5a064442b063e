"""Exact line de-duplication over all documents.

A line's key is the line without white space at its ends, lower-cased in A-Z. Keys of at least `min_chars`
code points that are found in at least `min_docs` documents lose all their lines but in the greatest doc_id.

Lines are dealt by ranges of (key hash, doc_id descending, position) and sorted so within each range; a task
streams its range once and sees the documents of a key one after the other, the one that keeps it first. As
doc_id and position are part of the range key, a line that stands in a third of all documents is cut over many
tasks. A key that touches an end of a task's range is settled afterwards from at most two keys a task.
What comes back is a bitmap of the lines to keep for each document that loses any, not text.

Nulls and edge cases: a null or empty text is one empty line; a null doc_id's lines count as one more document,
smaller than all others; extra columns are kept by `drop_lines`; repeated rows of a doc_id, or of none, are one document, and
each loses lines of its own text; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mark_of, save, shuffle_partitions, text_mark

WHITE = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h, g, doc, pos): a 128-bit key hash in two longs, for each line that is long enough; pos has the row's text_mark above its 32 bits."""

    def work(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys, doc, pos = [], [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                base = mark_of(text.encode()) << 32
                for p, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(WHITE)) >= min_chars:
                        keys.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        doc.append(ids[i])
                        pos.append(base | p)
            hashes = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(doc, pa.int64()), pa.array(pos, pa.int64())], names=["h", "g", "doc", "pos"])

    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(ids.alias("id"), text_col).mapInArrow(work, "h long, g long, doc long, pos long")


def stream_range(batches, min_docs: int):
    """From sorted (h, g, doc descending, pos) rows: what is dropped ('d'), and the rows ('p') and first documents ('s') of keys at the range's ends."""
    columns = ["h", "g", "doc", "pos"]
    carry, decided, first_key = None, None, None  # rows of the last key, or (key, greatest doc, first docs) once it has enough documents

    def out(rows: np.ndarray, tag: str):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)] + [pa.array([tag] * len(rows), pa.string())], names=[*columns, "tag"])

    for b in batches:
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
        if not len(rows):
            continue
        if first_key is None:
            first_key = tuple(rows[0, :2])
        if carry is not None:
            rows = np.concatenate([carry, rows])
            carry = None
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        lengths = np.diff(np.append(starts, len(rows)))
        new_doc = np.concatenate(([1], ~same | (rows[1:, 2] != rows[:-1, 2])))
        n_docs = np.add.reduceat(new_doc, starts)
        keys = rows[starts, :2]
        lo = 0
        if tuple(keys[0]) == first_key:  # may have begun before this range
            yield out(rows[: lengths[0]], "p")
            lo = 1
        elif decided is not None and tuple(keys[0]) == decided[0]:
            yield out(rows[: lengths[0]][rows[: lengths[0], 2] != decided[1]], "d")
            lo = 1
        if decided is not None and not (len(starts) == 1 and tuple(keys[0]) == decided[0]):
            decided = None
        if lo < len(starts):
            tops = np.repeat(rows[starts, 2], lengths)
            drop = np.repeat(n_docs >= min_docs, lengths) & (rows[:, 2] != tops)
            drop[: starts[lo]] = False
            last = slice(starts[-1], len(rows))
            if n_docs[-1] >= min_docs:
                firsts = rows[last][new_doc[last].astype(bool)][:min_docs]
                decided = (tuple(keys[-1]), firsts[0, 2], firsts)
            else:
                drop[last] = False
                carry = rows[last].copy()
            if drop.any():
                yield out(rows[drop], "d")
    if carry is not None:
        yield out(carry, "p")
    if decided is not None:
        yield out(decided[2], "s")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, pos): the lines to drop; pos as in hashed_lines."""
    spark = docs.sparkSession
    order = [F.col("h"), F.col("g"), F.col("doc").desc(), F.col("pos")]
    lines = save(hashed_lines(docs, id_col, text_col, min_chars), "hashes")  # ranges are sampled: lines are hashed once, not twice
    ranged = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = save(ranged.mapInArrow(lambda batches: stream_range(batches, min_docs), "h long, g long, doc long, pos long, tag string"), "lines")
    ends = found.where("tag <> 'd'")
    # At most two keys a task touch the ends of its range.
    settled = ends.groupBy("h", "g", "doc").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= min_docs)
    late = ends.where("tag = 'p'").join(F.broadcast(settled), ["h", "g"]).where("doc <> top")
    return found.where("tag = 'd'").select("doc", "pos").unionByName(late.select("doc", "pos"))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """The keep bitmap up to the byte with the last dropped line, compressed; later lines are kept."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(blob: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if blob:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))[:n]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, mark, bitmap) for each document that loses lines. A group is one document's lines, those of one text if it has several."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack_bitmap(np.asarray(x.as_py(), np.int64)) for x in b.column(2)], pa.binary())], names=["doc", "mark", "bitmap"])

    mark, place = F.shiftright("pos", 32), F.col("pos").bitwiseAND(F.lit((1 << 32) - 1))
    return dropped.groupBy("doc", mark.alias("mark")).agg(F.collect_set(place).alias("pos")).mapInArrow(pack, "doc long, mark long, bitmap binary")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, out: str = "keep_bitmap") -> DataFrame:
    """docs and a column of bitmaps, null for documents that lose nothing."""
    key, mark = fresh(docs, "_doc"), fresh(docs, "_mark")
    bitmaps = keep_bitmaps(dropped_lines(docs, id_col, text_col, min_chars, min_docs)).select(F.col("doc").alias(key), F.col("mark").alias(mark), F.col("bitmap").alias(out))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == F.col(key)) & (text_mark(docs[text_col]) == F.col(mark))
    return docs.join(bitmaps, same, "left").drop(key, mark)


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """(text of the kept lines, lines, dropped lines)."""
    lines = (text or "").split("\n")
    if not bitmap:
        return text or "", len(lines), 0
    keep = unpack_bitmap(bitmap, len(lines))
    return "\n".join(x for x, k in zip(lines, keep) if k), len(lines), int((~keep).sum())


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text of the kept lines (n_chars, if there, follows); all rows and columns stay, an untouched text stays as it is."""
    mark = fresh(docs, "keep_bitmap")
    marked = with_bitmaps(docs, min_chars=min_chars, min_docs=min_docs, out=mark)

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else kept_text(t, m)[0] for t, m in zip(text, bitmap)], dtype=object)

    out = marked.withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept("text", mark)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(docs.columns)


def op4_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches):
        for b in batches:
            kept = [kept_text(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0].encode()).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return with_bitmaps(docs).select("doc_id", "text", "keep_bitmap").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, p AS pos, l[p] AS line,
         translate(trim(l[p], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents),
       LATERAL (SELECT unnest(range(1, len(l) + 1)) AS p)
), keys AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, top IS NOT NULL AND doc_id <> top AS gone FROM lines LEFT JOIN keys USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
