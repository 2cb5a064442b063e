"""Shared pieces: tables in the shared folder, and vectorised views of texts inside tasks."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One Arrow batch is worked on in runs of documents of about so many bytes, to bound a task's memory.
RUN_BYTES = 1 << 20
MARK = (1 << 31) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session has none, and only on a local master, a temporary folder is taken.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_mark(text: F.Column) -> F.Column:
    """31 bits that tell rows of one id with different texts apart; as mark_of in tasks."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).bitwiseAND(F.lit(MARK))


def mark_of(text: bytes) -> int:
    return zlib.crc32(text) & MARK


def heavy(counted: DataFrame, on: str, count: str = "n", share: int = 1000) -> DataFrame:
    """(on): values with more than a `share`-th of all rows, so fewer than `share` of them; counted: (on, count)."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return save(counted.where(F.col(count) > total // share).select(on), "heavy")


def join_spread(left: DataFrame, right: DataFrame, on: str, hot: DataFrame, by: list[str], copies: int = 64) -> DataFrame:
    """left joined with right (one row a value of `on`): rows of hot values (see heavy) are dealt by a hash of columns `by` over copies of their row."""
    mark, salt = fresh(left, "_hot"), fresh(left, "_salt")
    few = F.broadcast(hot.withColumn(mark, F.lit(True)))
    dealt = left.join(few, on, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(*by), F.lit(copies)).cast("int")).otherwise(0)).drop(mark)
    every = F.explode(F.when(F.col(mark), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(right.join(few, on, "left").withColumn(salt, every).drop(mark), [on, salt]).drop(salt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(col: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo `of`; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(of), F.lit(0))


def crc_sql(text: str) -> str:
    """crc32 of an ASCII string as DuckDB SQL, bit by bit."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    bits = "lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bits})), 4294967295)"


# Byte classes: True where a byte belongs to a word.
SPACED = np.ones(256, bool)  # words are runs of bytes other than space and \t..\r
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)  # digits, lower-case letters and every non-ASCII byte, after lower-casing
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15 | 3), np.uint64(0xD1342543DE82EF93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverses modulo 2^64."""
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) <= n:
        size = max(n + 1, RUN_BYTES + (1 << 16))
        inverse = pow(int(base), -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row's begin; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each run of rows of a column."""
    data, offsets = bytes_of(column)
    for i, j in runs(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and each row's first word (one more at the end)."""
    inside = is_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # rows that aren't empty
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each word of data, alike wherever a word stands; each distinct word is hashed once."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(words.dictionary))
    return hashes[words.indices.to_numpy()] if len(starts) else hashes


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASE2, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] .. starts[i] + lengths[i] - 1."""
    if not len(starts):
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(len(shift))
