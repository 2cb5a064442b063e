"""Language-model scores by a Katz backoff model of any order from 2 on.

A word's probability after a history h of up to `order` - 1 words is, from the longest history down,
    kept(c) / c(h)                  if the history and the word were seen c times in training,
    alpha(h) * p(word | shorter h)  otherwise; alpha is 1 for a history that was never seen,
and alpha(h) is set so that all probabilities after h add up to exactly 1. kept(c) is the Good-Turing discounted count
for c up to `K` at each order, single words too; their lost mass goes to one unknown word. Counts above `K` stay whole for
single words; after a history they lose the constant `REST`. Katz leaves them whole there as well, but then a history with
only frequent words after it has no mass left, and any other word after it would be impossible.

The model is two tables in the shared folder, cut by ranges of hashes: counts of words and longer grams, and backoff weights of
histories. `fit_scores` counts and scores at once, in one exchange; `Model.scores` asks the stored tables again for other texts.

Documents stand in batches of some MB, stored once in a table bucketed by batch: distinct words' hashes, and tokens as their
places. Each batch sends the hashes of its distinct words and grams with its own training counts, packed, to the buckets of the
count tables, and each bucket adds up and answers each batch in the order it was asked: a count table of the grams of that batch,
and who of the batches speaks for a gram. Then batches send, for histories whose grams they speak for, the sums that alpha
needs, and get alpha back where they need it. At last each batch evaluates its tokens, level by level. A word in a
third of all documents is one entry of each batch: nothing hot is ever in one place, and since the table is bucketed, batches
are never shuffled. What is exchanged grows with the corpus. The batches' table is dropped from the catalog at the end.

Nulls and edge cases: a null or empty text is its end alone; a null doc_id counts as remainder 0; repeated rows are
counted and scored each; extra columns stay out; without training tokens every token is the unknown word, of
probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACED, crc_remainder, hash_words, mix, new_path, save, shuffle_partitions, split_words, text_runs

END, START = np.uint64(0x0D0C0E5D), np.uint64(0x57A27)
ORDER, K, REST = 2, 5, 0.1
BATCH_BYTES = 8 << 20
NO_ID = -(1 << 63)
#: The name of a row of the model's own tables among batches.
TABLE = -1


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte, as few bytes each as the greatest needs."""
    kind = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * k)
    return bytes([kind]) + np.ascontiguousarray(x.astype(f"<u{kind}").view(np.uint8).reshape(-1, kind).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)[1:].reshape(blob[0], -1)
    return np.ascontiguousarray(raw.T).view(f"<u{blob[0]}").ravel().astype(np.int64)


def narrow(x: np.ndarray) -> bytes:
    return zlib.compress(planes(x), 1)


def widen(blob: bytes) -> np.ndarray:
    return from_planes(zlib.decompress(blob))


def pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as their steps, with as few bytes each as the greatest needs."""
    if not len(hashes):
        return b""
    steps = np.diff(hashes)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + hashes[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8)[9:].reshape(-1, blob[0])
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8)[1:9]
    steps[1:, : blob[0]] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


BATCHES = "bid long, docs binary, held binary, sizes binary, words binary, tokens binary"


def batches_of(docs: DataFrame) -> str:
    """Stores (doc, held, text) in a table bucketed by batch, without a shuffle; returns its name."""
    spark = docs.sparkSession

    def work(batches):
        number, part = 0, TaskContext.get().partitionId()
        ids, held, texts, size = [], [], [], 0

        def flush():
            words, sizes = [], np.zeros(len(texts), np.int64)
            for i, j, data, at in text_runs(pa.array(texts, pa.large_binary())):
                data = LOWER[data]
                starts, ends, first = split_words(data, at, SPACED)
                words.append(hash_words(data, starts, ends))
                sizes[i:j] = np.diff(first)
            word = np.full(int(sizes.sum()) + len(sizes), END, np.uint64)
            inner = np.ones(len(word), bool)
            inner[np.cumsum(sizes + 1) - 1] = False
            word[inner] = np.concatenate(words) if words else np.zeros(0, np.uint64)
            distinct, tokens = np.unique(word, return_inverse=True)
            blobs = [np.array(ids, np.int64).tobytes(), np.array(held, np.uint8).tobytes(), planes(sizes), pack(distinct), planes(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) | number], pa.int64())] + [pa.array([x], pa.binary()) for x in blobs], names=[c.split()[0] for c in BATCHES.split(", ")])

        for b in batches:
            for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                text = text.as_py() or b""
                ids.append(doc)
                held.append(out)
                texts.append(text)
                size += len(text) + 64
                if size >= BATCH_BYTES:
                    yield flush()
                    number, ids, held, texts, size = number + 1, [], [], [], 0
        if ids:
            yield flush()

    name = f"katz_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(work, BATCHES)
    rows.write.option("compression", "zstd").option("path", new_path(spark, "batches")).bucketBy(shuffle_partitions(spark), "bid").format("parquet").saveAsTable(name)
    return name


@dataclass
class Level:
    """The grams of one length in a batch: distinct hashes, where each stands first, each token's, and training counts."""

    grams: np.ndarray
    first: np.ndarray
    at: np.ndarray
    counts: np.ndarray


class Batch:
    """The tokens of a stored batch and, for each order, its distinct grams."""

    def __init__(self, row: dict, order: int):
        self.bid = row["bid"]
        self.docs, self.held = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)
        counts, words, tokens = from_planes(row["sizes"]), unpack(row["words"]), from_planes(row["tokens"])
        self.doc = np.repeat(np.arange(len(counts)), counts + 1)
        begin = np.cumsum(counts + 1) - (counts + 1)
        place = np.arange(len(self.doc)) - begin[self.doc]
        train = ~self.held[self.doc]
        word = words[tokens]
        self.levels = [Level(words, np.zeros(0, np.int64), tokens, np.bincount(tokens, train, len(words)).astype(np.int64))]
        #: For each order from 2 on: which tokens have a history so long, and its hash. A text's start is part of histories.
        self.valid, self.history = [], []
        before = np.concatenate(([START], word[:-1]))
        before[begin] = START
        gram = word
        for length in range(2, order + 1):
            valid = place >= length - 2
            history = before if length == 2 else np.concatenate((gram[:1], gram[:-1]))
            gram = mix(history * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(length))
            own = gram[valid]
            grams, first, at = np.unique(own, return_index=True, return_inverse=True)
            where = np.flatnonzero(valid)
            whole = np.full(len(word), -1)
            whole[where] = at
            self.levels.append(Level(grams, where[first], whole, np.bincount(at, train[valid], len(grams)).astype(np.int64)))
            self.valid.append(valid)
            self.history.append(history)


@dataclass
class Buckets:
    """How many ranges of hashes there are for each order's grams, and for each order's histories."""

    grams: list[int]
    histories: list[int]

    @staticmethod
    def of(order: int, partitions: int) -> Buckets:
        grams = [max(1, partitions // 4)] + [partitions] * (order - 1)
        return Buckets(grams, grams[:-1])

    @staticmethod
    def filled(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """(range, begin, end) of the ranges that hold any of the sorted hashes; range k starts at k / n of the top 32 bits, rounded down."""
        if not len(hashes):
            return []
        top = (hashes >> np.uint64(32)).astype(np.int64)
        k = (top * n) >> 32
        k += top >= ((k + 1) << 32) // n
        begin = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
        return list(zip(k[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(k)]))


ASKED = "bucket int, bid long, hashes binary, counts binary"
TOLD = "bid long, bucket int, counts binary, speaks binary, stats array<long>, grams binary"


def _emit(out: list[tuple], kinds: tuple, names: list[str], size: int = 64):
    for i in range(0, len(out), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + size]), kinds)], names=names)


def ask(batches, order: int, buckets: Buckets):
    """Each order's grams go to buckets of their own."""
    for b in batches:
        for row in b.to_pylist():
            batch, out, base = Batch(row, order), [], 0
            for level, n in zip(batch.levels, buckets.grams):
                out += [(base + k, batch.bid, pack(level.grams[i:j]), narrow(level.counts[i:j])) for k, i, j in Buckets.filled(level.grams, n)]
                base += n
            yield from _emit(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), [c.split()[0] for c in ASKED.split(", ")])


def tell(t: pa.Table) -> pa.Table:
    """A bucket of the count tables: its answers to each batch; and, if it is being built, the bucket itself, and how many
    entries have each count up to K + 1 (last: entries, sum)."""
    t = t.sort_by("bid")
    bids = t.column("bid").to_pylist()
    lists = [unpack(x) for x in t.column("hashes").to_pylist()]
    sizes = [len(x) for x in lists]
    found, first, at = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate([widen(x) for x in t.column("counts").to_pylist()]), len(found)).astype(np.int64)
    speaks = np.zeros(len(at), bool)
    speaks[first] = total > 0
    ends = np.cumsum(sizes)
    bucket = t.column("bucket")[0].as_py()
    rows = [(b, bucket, narrow(total[at[e - n : e]]), np.packbits(speaks[e - n : e]).tobytes(), None, None) for b, n, e in zip(bids, sizes, ends) if b != TABLE]
    if bids[0] != TABLE:
        stats = [int((total == r).sum()) for r in range(1, K + 2)] + [int((total > 0).sum()), int(total.sum())]
        rows.append((TABLE, bucket, narrow(total[total > 0]), None, stats, pack(found[total > 0])))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=[c.split()[0] for c in TOLD.split(", ")])


@dataclass
class Totals:
    """What the whole model needs beside its tables: a few numbers, whatever the corpus."""

    tokens: int
    types: int
    unknown: float  # the unknown word's probability
    scale: float  # what a discounted count of a word counts for
    keep: list[np.ndarray]  # for each order and counts 0..K: what is left of the count after discounting
    starts: int

    @staticmethod
    def of(stats: list[list[int]], starts: int) -> Totals:
        """stats: for each order, how many grams have each count up to K + 1, how many there are, and the sum of counts."""
        keep = []
        for level, (*by, _, _) in enumerate(stats):
            left, top = np.zeros(K + 1), (K + 1) * by[K] / by[0] if by[0] else 0.0
            for r in range(1, K + 1):
                turing = (r + 1) * by[r] / by[r - 1] if by[r - 1] else r - 0.5
                d = (turing / r - top) / (1 - top) if top < 1 else 0.0
                left[r] = min(max(d * r, 0.1), r - REST) if level else min(max(d * r, 0.1), r)
            keep.append(left)
        n, by = stats[0][-1], stats[0]
        kept = sum(by[r - 1] * keep[0][r] for r in range(1, K + 1)) + n - sum(r * by[r - 1] for r in range(1, K + 1))
        unknown = 1 - kept / n if n else 1.0
        unknown = unknown if unknown > 1e-12 else 1 / (n + 1)
        return Totals(n, stats[0][-2], unknown, (1 - unknown) / kept if kept else 0.0, keep, starts)

    def kept(self, counts: np.ndarray, level: int) -> np.ndarray:
        return np.where(counts <= K, self.keep[level][np.minimum(counts, K)], counts - (REST if level else 0.0))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """What the unknown word leaves, in proportion to discounted counts."""
        return np.where(counts > 0, self.kept(counts, 0) * self.scale, self.unknown)


def table_of(batch: Batch, told: list[dict], buckets: Buckets) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(counts, which the batch speaks for) of each order's grams, from the answers to a batch."""
    counts = [np.zeros(len(x.grams), np.int64) for x in batch.levels]
    speaks = [np.zeros(len(x.grams), bool) for x in batch.levels]
    base = np.cumsum([0, *buckets.grams])
    places = [{k: (i, j) for k, i, j in Buckets.filled(x.grams, n)} for x, n in zip(batch.levels, buckets.grams)]
    for a in told:
        level = int(np.searchsorted(base, a["bucket"], "right")) - 1
        i, j = places[level][a["bucket"] - int(base[level])]
        counts[level][i:j] = widen(a["counts"])
        speaks[level][i:j] = np.unpackbits(np.frombuffer(a["speaks"], np.uint8))[: j - i].astype(bool)
    return counts, speaks


def at_tokens(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each token's count; 0 at -1, where it has no gram so long."""
    return np.append(counts, 0)[at]


def needed(batch: Batch, counts: list[np.ndarray], level: int) -> np.ndarray:
    """Sorted histories of an order that have a word after them that was never seen there."""
    own = batch.levels[level]
    valid = batch.valid[level - 1]
    unseen = valid.copy()
    unseen[valid] = counts[level][own.at[valid]] == 0
    return np.unique(batch.history[level - 1][unseen])


def history_counts(batch: Batch, counts: list[np.ndarray], level: int, starts: int) -> np.ndarray:
    """How often each token's history was seen in training: the count of its words, one order below."""
    found = at_tokens(counts[level - 1], np.concatenate(([-1], batch.levels[level - 1].at[:-1])))
    return np.where(batch.history[0] == START, starts, found) if level == 1 else found


SUMS = K + 1  # grams with counts 1..K, and grams above K


def ask_alpha(batches, order: int, buckets: Buckets, totals: Totals):
    """For each history that a batch speaks for: the sums that alpha needs; with the histories it needs."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary())
    for b in batches:
        for row in b.to_pylist():
            batch, out, base = Batch(row, order), [], 0
            counts, speaks = table_of(batch, row["told"], buckets)
            lower = totals.unigram(counts[0])[batch.levels[0].at]
            for level in range(1, order):
                own = np.flatnonzero(speaks[level])
                token = batch.levels[level].first[own]
                history, c = batch.history[level - 1][token], counts[level][own]
                needs = needed(batch, counts, level)
                every, where = np.unique(np.concatenate([history, needs]), return_inverse=True)
                where = where[: len(own)]
                sums = [np.bincount(where, c == r, len(every)) for r in range(1, K + 1)] + [np.bincount(where, c > K, len(every))]
                below = np.bincount(where, lower[token], len(every))
                need = np.isin(every, needs)
                n = buckets.histories[level - 1]
                out += [(base + k, batch.bid, pack(every[i:j]), [narrow(s[i:j].astype(np.int64)) for s in sums], below[i:j].tobytes(), np.packbits(need[i:j]).tobytes()) for k, i, j in Buckets.filled(every, n)]
                base += n
                # A gram that was seen was seen one order below too, so its probability there needs no alpha.
                seen = batch.valid[level - 1]
                lower = np.where(seen, totals.kept(at_tokens(counts[level], batch.levels[level].at), level) / np.maximum(history_counts(batch, counts, level, totals.starts), 1), lower)
            yield from _emit(out, kinds, ["bucket", "bid", "hashes", "sums", "below", "need"])


def tell_alpha(t: pa.Table, totals: Totals, levels: np.ndarray) -> pa.Table:
    """A bucket of histories: lost mass over what the order below is left with, for the histories each batch needs, in order;
    and, if it is being built, the bucket itself. The history's own count is the batch's to divide by.
    """
    t = t.sort_by("bid")
    bids, bucket = t.column("bid").to_pylist(), t.column("bucket")[0].as_py()
    lists = [unpack(x) for x in t.column("hashes").to_pylist()]
    found, at = np.unique(np.concatenate(lists), return_inverse=True)
    ends = np.cumsum([len(x) for x in lists])
    building = bids[0] != TABLE
    if building:
        level = int(np.searchsorted(levels, bucket, "right")) + 1
        packed = t.column("sums").to_pylist()
        sums = [np.bincount(at, np.concatenate([widen(p[k]) for p in packed]), len(found)) for k in range(SUMS)]
        below = np.bincount(at, np.concatenate([np.frombuffer(x, np.float64) for x in t.column("below").to_pylist()]), len(found))
        lost = sum((r - totals.keep[level][r]) * sums[r - 1] for r in range(1, K + 1)) + REST * sums[K]
        weight = lost / np.maximum(1 - below, 1e-300)
    else:
        weight = np.zeros(len(found))
        weight[at[: ends[0]]] = np.frombuffer(t.column("below")[0].as_py(), np.float64)
    rows = []
    for b, x, e, need in zip(bids, lists, ends, t.column("need").to_pylist()):
        if b != TABLE:
            mask = np.unpackbits(np.frombuffer(need, np.uint8))[: len(x)].astype(bool)
            rows.append((b, bucket, weight[at[e - len(x) : e][mask]].tobytes(), None))
    if building:
        known = np.sum(sums, axis=0) > 0
        rows.append((TABLE, bucket, weight[known].tobytes(), pack(found[known])))
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bid", "bucket", "alphas", "histories"])


def score_batches(batches, order: int, buckets: Buckets, totals: Totals):
    base_of = np.cumsum([0, *buckets.histories])
    for b in batches:
        for row in b.to_pylist():
            batch = Batch(row, order)
            counts, _ = table_of(batch, row["told"], buckets)
            c = counts[0][batch.levels[0].at]
            p = totals.unigram(c)
            told = sorted(row["alphas"] or [], key=lambda a: a["bucket"])
            for level in range(1, order):
                needs = needed(batch, counts, level)
                weight = np.concatenate([np.frombuffer(a["alphas"], np.float64) for a in told if base_of[level - 1] <= a["bucket"] < base_of[level]] or [np.zeros(0)])
                valid = batch.valid[level - 1]
                gram = at_tokens(counts[level], batch.levels[level].at)
                h = history_counts(batch, counts, level, totals.starts)
                here = totals.kept(gram, level) / np.maximum(h, 1)
                unseen = valid & (gram == 0)
                if unseen.any():
                    own = h[unseen]
                    here[unseen] = np.where(own > 0, weight[np.searchsorted(needs, batch.history[level - 1][unseen])] / np.maximum(own, 1), 1.0) * p[unseen]
                p = np.where(valid, here, p)
            n = len(batch.docs)
            base = np.log10((c + 1) / (totals.tokens + totals.types + 1))
            ids = pa.array(batch.docs, pa.int64(), mask=batch.docs == NO_ID)
            cols = [
                np.bincount(batch.doc, minlength=n), np.bincount(batch.doc, c > 0, n).astype(np.int64), np.full(n, totals.tokens),
                np.bincount(batch.doc, base, n), np.bincount(batch.doc, np.log10(np.maximum(p, 1e-300)), n),
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(batch.held), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


WEIGHTS = "bid long, bucket int, alphas binary, histories binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """A trained model: where its two tables are, and its totals."""

    order: int
    buckets: Buckets
    totals: Totals
    counts: str
    alphas: str

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scores of other documents, from the stored tables; columns as in fit_scores, held_out throughout."""
        return _scores(docs, F.lit(True), id_col, text_col, self.order, self)[1]


def _scores(docs: DataFrame, held: F.Column, id_col: str, text_col: str, order: int, model: Model | None) -> tuple[Model, DataFrame]:
    spark: SparkSession = docs.sparkSession
    name = batches_of(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), held.alias("held"), F.col(text_col).alias("text")))
    try:
        stored = spark.table(name)
        if model:
            buckets = model.buckets
        else:
            size = stored.agg(F.sum(F.length("tokens"))).first()[0] or 0
            # A bucket has a gram once for each batch, and some hundred thousand entries.
            buckets = Buckets.of(order, max(shuffle_partitions(spark), int(size // (5 << 20)) + 1))
        asked = stored.mapInArrow(lambda x: ask(x, order, buckets), ASKED)
        if model:
            asked = asked.unionByName(spark.read.schema(TOLD).parquet(model.counts).where(F.col("bid") == TABLE).select("bucket", "bid", F.col("grams").alias("hashes"), "counts"))
        counts = new_path(spark, "counts")
        asked.groupBy("bucket").applyInArrow(tell, TOLD).write.option("compression", "zstd").parquet(counts)
        told = spark.read.schema(TOLD).parquet(counts)
        base = np.cumsum([0, *buckets.grams]).tolist()
        if model:
            totals = model.totals
        else:
            level = sum((F.col("bucket") >= k).cast("int") for k in base[1:-1]) if order > 1 else F.lit(0)
            found = {r[0]: [int(x) for x in r[1:]] for r in told.where("stats is not null").groupBy(level.alias("level")).agg(*(F.sum(F.col("stats")[i]) for i in range(K + 3))).collect()}
            totals = Totals.of([found.get(k, [0] * (K + 3)) for k in range(order)], docs.where(~held).count())
        # A group is one batch's answers.
        answers = told.where(F.col("bid") != TABLE).groupBy("bid").agg(F.collect_list(F.struct("bucket", "counts", "speaks")).alias("told"))
        known = stored.join(answers, "bid")
        levels = np.cumsum(buckets.histories)
        kinds = "bucket int, bid long, hashes binary, sums array<binary>, below binary, need binary"
        asked = known.mapInArrow(lambda x: ask_alpha(x, order, buckets, totals), kinds)
        if model:
            own = spark.read.schema(WEIGHTS).parquet(model.alphas).where(F.col("bid") == TABLE)
            asked = asked.unionByName(own.select("bucket", "bid", F.col("histories").alias("hashes"), F.lit(None).cast("array<binary>").alias("sums"), F.col("alphas").alias("below"), F.lit(None).cast("binary").alias("need")))
        alphas = new_path(spark, "alphas")
        asked.groupBy("bucket").applyInArrow(lambda t: tell_alpha(t, totals, levels), WEIGHTS).write.option("compression", "zstd").parquet(alphas)
        answered = spark.read.schema(WEIGHTS).parquet(alphas).where(F.col("bid") != TABLE).groupBy("bid").agg(F.collect_list(F.struct("bucket", "alphas")).alias("alphas"))
        result = save(known.join(answered, "bid", "left").mapInArrow(lambda x: score_batches(x, order, buckets, totals), SCORES), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return model or Model(order, buckets, totals, counts, alphas), result


def fit_scores(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[Model, DataFrame]:
    """The model of the rows where `held` is false, and (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows."""
    if order < 2:
        raise ValueError("the order is at least 2")
    return _scores(docs, held, id_col, text_col, order, None)


def op8_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fit_scores(docs, crc_remainder("doc_id", 7) == 2)[1]
