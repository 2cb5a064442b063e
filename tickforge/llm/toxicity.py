"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its n-grams (3 to 6 bytes, with marks at its ends) and of itself, hashed into buckets with
an embedding each; a span is the average of its words, a softmax over two classes scores it. Words that were
never seen, misspellings among them, get their score from n-grams that were.

A toxic document may hold one toxic word among thousands of clean ones, which an average over all of it would
drown. So a document's logit is its most toxic span's (`SPAN` consecutive words, sliding), and training goes in
two phases: first each span takes its document's label; then a document counts by the softmax over its own spans'
logits, so that a toxic one is answered for by its toxic spans and a clean one by what looks most toxic in it
(multiple-instance learning). Embeddings and weights carry an L2 penalty, without which they learn documents by heart.

The sample is cut into `FOLDS` by a hash of the text, so copies stay together. A model is trained without each fold, a
task each, and says how that fold's documents score: logits of texts it hasn't seen. On these the cut is chosen that has
the most recall less `PRICE` times the false alarms; a score of 0.5 is that cut, and its slope is a ridge fit at the
classes' true shares. The model that scores is one of the same kind, trained on the whole sample by one more task, so cut and
scores are both of the greatest span logit of a single model.

Training takes a bounded sample: at most `per_class` labelled documents of either class, those whose ids have
the smallest hashes; the driver gets the models alone, and a logit for each sampled document. Scoring takes every document,
whole: a map without a shuffle. A model is one number for each bucket once embeddings and softmax are multiplied out,
1 MB whatever the input.

Nulls and edge cases: texts without words, null and empty ones too, score the share of toxic labels; null labels and ids
aren't learned from; repeated labels of an id count once, toxic if any is; of repeated rows of an id the least text is learned
from; without labels of both classes the score is the share of toxic labels, 0 without any; a class in one fold alone is
learned from by all; extra columns stay out of scores; rows with a null id are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _powers, crc_remainder, fresh, mix, ranges, save

BUCKETS, DIM, SPAN, GRAMS = 1 << 17, 8, 3, (3, 4, 5, 6)
PER_CLASS, FOLDS, PRICE = 2000, 3, 2.0
CACHE = 400_000
EDGES = bytes(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz"))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of each n-gram and whole word; words in lower case without punctuation at their ends."""
    joined = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    up, down = _powers(_BASE, len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    own, hashes = [np.arange(len(words))], [(sums[ends] - sums[ends - lengths]) * down[ends - lengths] + np.uint64(1)]
    for n in GRAMS:
        if len(joined) >= n:
            at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
            own.append(owner[at])
            hashes.append((sums[at + n] - sums[at]) * down[at] + np.uint64(n))
    return np.concatenate(own), (mix(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)


def clean_word(token: bytes) -> bytes:
    return token.lower().strip(EDGES)


def span_means(scores: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Means of every `span` consecutive scores (of all, if fewer; nan without any)."""
    if len(scores) <= span:
        return np.array([scores.mean() if len(scores) else np.nan])
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return (sums[span:] - sums[:-span]) / span


@dataclass
class Model:
    """What scoring needs: a number for each bucket, and offset and slope of the logit."""

    buckets: np.ndarray | None
    offset: float
    slope: float
    constant: float = 0.0

    def words(self, words: list[bytes]) -> np.ndarray:
        own, at = features(words)
        return np.bincount(own, self.buckets[at], len(words)) / np.maximum(np.bincount(own, minlength=len(words)), 1)

    def probability(self, top: np.ndarray) -> np.ndarray:
        if self.buckets is None:
            return np.full(len(top), self.constant)
        return np.where(np.isnan(top), self.constant, 1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -30, 30))))


class Scorer:
    """Scores texts; keeps the scores of the words met so far, up to CACHE."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def tops(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        known = self.known
        new = list({w for s in split for w in s if w not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({w for s in split for w in s})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, self.model.words([clean_word(w) for w in part]).tolist()))
        return np.array([span_means(np.fromiter(map(known.__getitem__, s), float, len(s))).max() for s in split])


class Sample:
    """Texts as words, their n-grams by word and by bucket, and the spans of each text."""

    def __init__(self, texts: list[bytes], span: int = SPAN):
        ids: dict[bytes, int] = {}
        docs = [np.array([ids.setdefault(clean_word(w), len(ids)) for w in t.split() or [b""]], np.int32) for t in texts]
        vocab = list(ids)
        del ids  # what isn't needed any more goes at once: a task's peak is here
        own, at = [], []
        for i in range(0, len(vocab), 20_000):
            o, a = features(vocab[i : i + 20_000])
            own.append((o + i).astype(np.int32))
            at.append(a.astype(np.int32))
        self.n = len(vocab)
        del vocab
        own = np.concatenate(own)
        at = np.concatenate(at)
        order = np.argsort(own, kind="stable").astype(np.int32)
        self.at = at[order]
        del order
        self.words, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        del docs
        self.per = np.bincount(own, minlength=self.n).astype(np.float32)
        self.word_begin = np.cumsum(self.per).astype(np.int64) - self.per.astype(np.int64)
        order = np.argsort(at, kind="stable").astype(np.int32)
        self.own = own[order]
        del own
        at = at[order]
        del order
        self.used_begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.used = at[self.used_begin]
        del at
        first = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - span + 1, 1)
        self.begin = ranges(first, counts).astype(np.int32)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
        self.doc_begin = np.cumsum(counts) - counts
        self.size = np.minimum(sizes, span).astype(np.uint8)[self.doc]
        self.spans = counts

    def logits(self, per_bucket: np.ndarray) -> np.ndarray:
        """Of each span, without the softmax's offset."""
        word = np.add.reduceat(per_bucket[self.at], self.word_begin) / self.per
        sums = np.concatenate(([0.0], np.cumsum(word[self.words], dtype=float)))
        found = sums[self.begin + self.size]
        found -= sums[self.begin]
        found /= self.size
        return found

    def gradient(self, of_spans: np.ndarray) -> np.ndarray:
        """Of the used buckets, for a gradient of the spans' logits."""
        change = np.zeros(len(self.words) + 1)
        share = of_spans / self.size
        change[self.begin] += share
        change -= np.bincount(self.begin + self.size, share, len(change))  # texts shorter than a span may end together
        of_words = np.bincount(self.words, np.cumsum(change)[:-1], self.n) / self.per
        return np.add.reduceat(of_words.astype(np.float32)[self.own], self.used_begin)

    def tops(self, per_bucket: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(self.logits(per_bucket), self.doc_begin)


def train(sample: Sample, labels: np.ndarray, steps: tuple[int, int] = (30, 60), rate: float = 0.1, penalty: float = 1e-4, seed: int = 7) -> np.ndarray:
    """A number for each bucket, the softmax's offset taken in; labels: 0 or 1 for each text, both there."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    y = labels.astype(np.int8)[sample.doc]
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())  # of a document
    for t in range(1, sum(steps) + 1):
        e, w, b = params
        u = w[:, 1] - w[:, 0]
        z = sample.logits(e @ u) + b[1] - b[0]
        if t <= steps[0]:
            part = 1 / sample.spans[sample.doc]
        else:
            part = np.exp(z - np.maximum.reduceat(z, sample.doc_begin)[sample.doc])
            part /= np.add.reduceat(part, sample.doc_begin)[sample.doc]
        # In place: spans are many, and each array of theirs counts.
        np.clip(z, -30, 30, out=z)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        np.divide(1, z, out=z)
        z -= y
        part *= share[sample.doc]
        part *= z
        d = part
        of_buckets = sample.gradient(d)
        held = e[sample.used]
        of_e = np.zeros_like(e)
        of_e[sample.used] = np.outer(of_buckets, u) + penalty * held
        of_u = held.T @ of_buckets + penalty * u
        for i, g in enumerate((of_e, np.stack([-of_u, of_u], 1), np.array([-d.sum(), d.sum()], np.float32))):  # Adam
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    e, w, b = params
    return e @ (w[:, 1] - w[:, 0]) + (b[1] - b[0])  # every bucket takes the offset in, so every average does


def cross_fit(texts: list[bytes], labels: np.ndarray, out: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each bucket, trained on the texts that aren't `out`; logits of those that are)."""
    inner = ~out if 0 < labels[~out].sum() < (~out).sum() else np.ones(len(out), bool)
    per_bucket = train(Sample([t for t, k in zip(texts, inner) if k]), labels[inner], seed=seed)
    held = [t for t, k in zip(texts, out) if k]
    return per_bucket, Sample(held).tops(per_bucket) if held else np.zeros(0)


def calibrate(tops: np.ndarray, labels: np.ndarray, share: float, price: float = PRICE) -> tuple[float, float]:
    """(slope, offset) of the score for logits of unseen texts: 0.5 is the cut of most recall less `price` times the false alarms."""
    order = np.argsort(tops, kind="stable")
    z, y = tops[order], labels[order]
    missed, alarms = np.append(0, np.cumsum(y)) / max(y.sum(), 1), np.append(np.cumsum((1 - y)[::-1])[::-1], 0) / max((1 - y).sum(), 1)
    between = np.concatenate(([True], z[1:] > z[:-1], [True]))  # equal logits stay together
    worth = np.where(between, -missed - price * alarms, -np.inf)
    at = int(np.flatnonzero(worth == worth.max())[-1])
    cut = z[0] - 1 if at == 0 else z[-1] + 1 if at == len(z) else (z[at - 1] + z[at]) / 2
    low, high = np.quantile(z, [0.01, 0.99])
    scale = max(high - low, 1e-6) / 4
    x, slope = np.clip((z - cut) / scale, -4, 4), 1.0
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    for _ in range(50):  # Newton steps of a ridge fit through the cut
        p = 1 / (1 + np.exp(-slope * x))
        slope -= float(np.clip(((weight * (p - y) * x).sum() + 1e-3 * slope) / ((weight * p * (1 - p) * x * x).sum() + 1e-3), -2, 2))
    slope = max(slope, 0.1) / scale
    return slope, -slope * cut


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS, text_col: str = "text") -> Model:
    """Learns from at most `per_class` labelled documents of each class."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    constant = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Model(None, 0.0, 1.0, constant)
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    # The sample has at most 2 * per_class rows.
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col).where(F.length("text") > 0)
    sample = save(rows.groupBy(id_col).agg(F.min("text").alias("text"), F.first("_y").alias("y")).select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold")), "sample")

    def learn(t: pa.Table) -> pa.Table:
        found = sorted((x.encode(), y, k) for x, y, k in zip(t.column("text").to_pylist(), t.column("y").to_pylist(), t.column("fold").to_pylist()))
        number = t.column("without")[0].as_py()  # FOLDS: without none
        y, out = np.array([f[1] for f in found], float), np.array([f[2] == number for f in found])
        if not 0 < y.sum() < len(y):
            return pa.table({"buckets": pa.array([], pa.binary()), "tops": pa.array([], pa.binary()), "labels": pa.array([], pa.binary())})
        buckets, tops = cross_fit([f[0] for f in found], y, out, number)
        return pa.table({"buckets": pa.array([buckets.astype(np.float32).tobytes() if number == FOLDS else None], pa.binary()), "tops": pa.array([tops.tobytes()], pa.binary()), "labels": pa.array([y[out].tobytes()], pa.binary())})

    copies = sample.withColumn("without", F.explode(F.array(*(F.lit(k) for k in range(FOLDS + 1)))))
    got = copies.groupBy("without").applyInArrow(learn, "buckets binary, tops binary, labels binary").collect()
    if not got:
        return Model(None, 0.0, 1.0, constant)
    tops, y = (np.concatenate([np.frombuffer(r[k], float) for r in got]) for k in ("tops", "labels"))
    slope, offset = calibrate(tops, y, constant)
    return Model(next(np.frombuffer(r.buckets, np.float32) for r in got if r.buckets), offset, slope, constant)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and a column of scores from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":
        model = held.value
        scorer = Scorer(model)
        for texts in batches:
            found = [np.zeros(0)]
            for i in range(0, len(texts), 256):
                part = [(t or "").encode() for t in texts.iloc[i : i + 256]]
                found.append(scorer.tops(part) if model.buckets is not None else np.zeros(len(part)))
            yield pd.Series(model.probability(np.concatenate(found)))

    return docs.withColumn(out, scored(F.coalesce(text_col, F.lit(""))))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that score below the threshold."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels, id_col, text_col=text_col), text_col, out=name).where(F.col(name) < threshold).select(docs.columns)
