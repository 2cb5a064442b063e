"""A content-addressed store of token ids.

A rolling hash over `ROLL` ids cuts each document's ids into chunks of about `MEAN` (between `LEAST` and `MOST`), so
that equal passages make equal chunks wherever they stand. A chunk's name is the BLAKE2b hash of its ids, and its
ids are stored once: by the first document, in order of doc_id, that has it. The store is a Parquet table in ascending
doc_id order with one row a document: its recipe (names and lengths of its chunks), its root (Merkle tree over
the names), the ids of the chunks that are its own alone (`own`) and of those that others name too (`shared`). Each
range of documents is written in runs of at most `RUN` documents, and each run ends with a manifest row: how many documents and ids it has,
and the root over its documents' roots.

Writing shuffles ids once, to the range of their doc_id; who stores a chunk is settled on names alone. Reading
takes documents that have all their chunks from where they stand; for the others only the shared chunks move.
Names that many documents share are salted in both joins, so a common chunk is copied to a bounded number of tasks.
Every chunk is checked against its name, every document against its root and every run against its manifest.

Nulls and edge cases: a null or empty text is its end id alone; a null doc_id comes first in the order; repeated rows
of a doc_id, equal or not, are written and read back each, next to each other in no stated order; extra columns stay out; empty tables make an empty store.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_windows, heavy, join_spread, mix, new_path, save, shuffle_partitions
from .tokens import default_path, encoded, forget, small_batches

ROLL, LEAST, MEAN, MOST = 8, 64, 512, 4096
NAME, RUN = 16, 4096
#: Documents whose ids a task that writes or reads the store has unpacked at a time.
ROWS = 500


@functools.cache
def small_ids() -> np.ndarray:
    """The hash of each id of two bytes."""
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def chunk_ends(blobs: list[bytes], dtype: np.dtype) -> list[list[int]]:
    """Where the chunks of each document's ids end."""
    sizes = [len(x) // dtype.itemsize for x in blobs]
    ids = np.frombuffer(b"".join(blobs), dtype)
    hashes = small_ids()[ids] if dtype.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(1))
    cuts = np.flatnonzero(hash_windows(hashes, ROLL) & np.uint64(MEAN - 1) == 0) + ROLL
    begin, out = 0, []
    where = np.searchsorted(cuts, np.cumsum([0, *sizes])).tolist()
    all_cuts = cuts.tolist()
    for n, i, j in zip(sizes, where[:-1], where[1:]):
        ends, last = [], 0
        for c in all_cuts[i : j + 1]:
            c -= begin
            if c - last < LEAST or c - ROLL < 0:  # a window that begins in the document before is none of its own
                continue
            if c >= n:
                break
            while c - last > MOST:
                last += MOST
                ends.append(last)
            last = c
            ends.append(c)
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if n > last:
            ends.append(n)
        begin += n
        out.append(ends)
    return out


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NAME).digest()


def merkle(names: list[bytes]) -> bytes:
    """The root of a tree over the names; an odd one out goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=NAME).digest() for x in names] or [name_of(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=NAME).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split_names(blob: bytes) -> list[bytes]:
    return [blob[i : i + NAME] for i in range(0, len(blob), NAME)]


def chunked_ids(docs: DataFrame, path: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, names, lengths, ids): one row a document."""

    def work(batches):
        for b in small_batches(batches, 1000):
            names, lengths, blobs, width, dtype = [], [], [], 0, np.dtype("<u2")
            for _, ids, dtype in encoded(b.column(1).cast(pa.binary()), path, kind, end_id):
                width = dtype.itemsize
                blobs.append(ids)
            parts = (blobs[i : i + 500] for i in range(0, len(blobs), 500))  # hashes take 8 bytes an id, several times over
            for ids, ends in ((x, e) for part in parts for x, e in zip(part, chunk_ends(part, dtype))):
                begins = [0, *ends[:-1]]
                names.append(b"".join([name_of(ids[i * width : j * width]) for i, j in zip(begins, ends)]))
                lengths.append(array("I", [j - i for i, j in zip(begins, ends)]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in (names, lengths, blobs)), pa.array([width] * len(names), pa.int32())], names=["doc_id", "names", "lengths", "ids", "width"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(work, "doc_id long, names binary, lengths binary, ids binary, width int")


STORED = "part int, run int, kind string, doc_id long, start long, n_tokens long, width int, root binary, names binary, lengths binary, foreign boolean, own binary, shared array<struct<name:binary,ids:binary>>"


def write_range(batches):
    """Stored rows of a range: rows (doc_id, copy marks first) sorted by doc_id; a mark is a chunk that several documents name."""
    part, start, run, run_start, roots = TaskContext.get().partitionId(), 0, 0, 0, []
    schema = pa.schema(
        [("part", pa.int32()), ("run", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("root", pa.binary()), ("names", pa.binary()), ("lengths", pa.binary()), ("foreign", pa.bool_()), ("own", pa.binary()), ("shared", pa.list_(pa.struct([("name", pa.binary()), ("ids", pa.binary())])))]
    )

    def manifest() -> tuple:
        return part, run, "m", None, len(roots), start - run_start, None, merkle(roots), None, None, False, None, None

    marks: tuple[object, dict[bytes, bool]] = (None, {})
    seen: set[bytes] = set()
    forget()
    for b in small_batches(batches, ROWS):
        rows = []
        for doc, mark, names, lengths, ids, width in zip(*(b.column(k).to_pylist() for k in range(6))):
            if mark is not None:
                marks = (doc, {name[:NAME]: name[NAME:] == b"\1" for name in mark})
                seen = set()
                continue
            own_marks = marks[1] if marks[0] == doc else {}
            own, shared, foreign, at = [], [], False, 0
            for name, n in zip(split_names(names), np.frombuffer(lengths, "<u4").tolist()):
                data = ids[at : at + n * width]
                at += n * width
                if name not in own_marks:
                    own.append(data)
                elif not own_marks[name]:
                    foreign = True
                elif name not in seen:
                    seen.add(name)
                    shared.append({"name": name, "ids": data})
            n = len(ids) // width
            root = merkle(split_names(names))
            rows.append((part, run, "d", doc, start, n, width, root, names, lengths, foreign or bool(own_marks), b"".join(own), shared))
            roots.append(root)
            start += n
            if len(roots) == RUN:
                rows.append(manifest())
                run, run_start, roots = run + 1, start, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if roots:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(manifest(), schema)], schema=schema)


def write(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    staged = save(chunked_ids(docs, tokenizer, kind, end_id, id_col, text_col), "ids")
    named = staged.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("names"), F.lit(NAME)), F.lit(NAME)), lambda i: F.substring(F.col("names"), i, F.lit(NAME)))).alias("seq", "name"))
    several = named.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "seq")).alias("first")).where("n > 1").select("name", F.col("first.d").alias("d"), "n")
    several = save(several, "several")
    mark = F.concat("name", F.when(F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("d"), F.lit(b"\1")).otherwise(F.lit(b"\0")))
    # A group is one document's chunks.
    marks = join_spread(named, several.drop("n"), "name", heavy(several, "name"), ["doc_id", "seq"]).groupBy("doc_id").agg(F.collect_set(mark).alias("mark")).select("doc_id", "mark", *(F.lit(None).cast(t).alias(c) for c, t in (("names", "binary"), ("lengths", "binary"), ("ids", "binary"), ("width", "int"))))
    rows = staged.select("doc_id", F.lit(None).cast("array<binary>").alias("mark"), "names", "lengths", "ids", "width").unionByName(marks)
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.col("mark").isNull())
    ordered.mapInArrow(write_range, STORED).write.option("compression", "zstd").parquet(path)


def verify(names: bytes, lengths: bytes, root: bytes, width: int, own: bytes, others: dict[bytes, bytes]) -> bytes:
    """A document's ids from its own and other chunks."""
    out, at = [], 0
    for name, n in zip(split_names(names), np.frombuffer(lengths, "<u4").tolist()):
        data = others.get(name)
        if data is None:
            data = own[at : at + n * width]
            at += n * width
        if len(data) != n * width or name_of(data) != name:
            raise ValueError("a chunk doesn't match its name")
        out.append(data)
    if at != len(own) or merkle(split_names(names)) != root:
        raise ValueError("a document doesn't match its root")
    return b"".join(out)


def before_ranges(spark: SparkSession, path: str) -> dict[int, int]:
    """part -> how many ids all parts before it have, from the manifests: a row a range."""
    found, at = {}, 0
    for r in spark.read.schema(STORED).parquet(path).where("kind = 'm'").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        found[r.part] = at
        at += r.n
    return found


def check_runs(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless each run's documents make up its manifest. A group is one run's roots."""
    stored = spark.read.schema(STORED).parquet(path)
    found = stored.where("kind = 'd'").groupBy("part", "run").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("roots"))

    def roots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([merkle([x["root"] for x in r]) for r in b.column(4).to_pylist()], pa.binary())], names=["part", "run", "n", "docs", "root"])

    kinds = "part int, run int, n long, docs long, root binary"
    told = stored.where("kind = 'm'").select("part", "run", F.col("n_tokens").alias("n"), F.col("start").alias("docs"), "root")
    both = found.mapInArrow(roots, kinds).select("part", "run", F.struct("n", "docs", "root").alias("found")).join(told.select("part", "run", F.struct("n", "docs", "root").alias("told")), ["part", "run"], "full")
    if both.where(~F.col("found").eqNullSafe(F.col("told"))).take(1):
        raise ValueError("a run doesn't match its manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids, verified, as little-endian 4-byte integers; start counts the ids of all documents before it."""
    check_runs(spark, path)
    before = before_ranges(spark, path)
    rows = spark.read.schema(STORED).parquet(path).where("kind = 'd'")
    shared = rows.where(F.size("shared") > 0).select(F.explode("shared").alias("c")).select("c.name", "c.ids")
    row = F.xxhash64("part", "start")  # a row's place names it
    mixed = rows.where("foreign").withColumn("row", row)
    needed = mixed.select("row", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("names"), F.lit(NAME)), lambda i: F.substring(F.col("names"), i, F.lit(NAME))))).alias("name"))
    # A group is one document's chunks.
    others = join_spread(needed, shared, "name", heavy(needed.groupBy("name").agg(F.count("*").alias("n")), "name"), ["row"]).groupBy("row").agg(F.collect_list(F.struct("name", "ids")).alias("others"))
    columns = ["doc_id", "part", "start", "n_tokens", "width", "root", "names", "lengths", "own"]
    whole = rows.where("not foreign").select(*columns, F.lit(None).cast("array<struct<name:binary,ids:binary>>").alias("others"))
    joined = mixed.join(others, "row", "left").select(*columns, "others")

    def rebuild(batches):
        forget()
        for b in small_batches(batches, ROWS):
            doc, part, start, n, width, root, names, lengths, own, others = (c.to_pylist() for c in b.columns)
            ids = [np.frombuffer(verify(m, s, r, w, o, {x["name"]: x["ids"] for x in e or ()}), f"<u{w}").astype("<u4").tobytes() for m, s, r, w, o, e in zip(names, lengths, root, width, own, others)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([before[p] + s for p, s in zip(part, start)], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.unionByName(joined).mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path("word_bpe_49k.json"), "word", 2)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
