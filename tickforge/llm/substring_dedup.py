"""Exact substring de-duplication by suffix automata of reference shards.

A window is `window` consecutive words of a document. It goes if its words also start in a document with a smaller
doc_id, and a word goes if any window over it goes.

1. Each window has a key: the least hash of its `GRAM`-word grams. Equal windows have equal keys, and a document has a
   key for about twenty words. Documents meet on keys; only windows under keys that several documents have go on.
2. Those windows' hashes meet in buckets, packed, once for each batch of documents. What is left are passages: runs
   of windows that (but for hash collisions) occur in several documents.
3. A passage is cut into pieces, runs of windows under one key. Equal pieces are collapsed to the smallest doc_id, and
   reference shards, bounded in words, take all pieces of a key. A shard takes its pieces in ascending doc_id: each is
   streamed through the suffix automaton of the documents before it, following suffix links where it stops matching, and the
   matching statistics say which windows an earlier document has, and which document is the first. A piece with a window
   that is new then goes into the automaton itself. The statistics decide; the hashes before only spare work.
4. Each document takes the answers of its pieces, and its removed windows become spans.

A shard's automaton meets the pieces of its keys instead of every document: other documents can't match it, and
a broadcast to all would make the work grow as the square of the corpus. If the different pieces of a key have more than
`HOT` words, they are cut again under longer keys, the least hashes of grams of twice and four times as many words and at last
of the window itself, each time only those that are still too many. Equal windows have equal keys of any length, so they meet in
one shard's automaton however often a key is cut. Keys and pieces that many documents have are salted where they are joined.

Nulls and edge cases: a null text has no words; documents shorter than a window lose nothing; a document without a
doc_id loses nothing and takes nothing from others; repeated rows of a doc_id, equal or not, lose what an earlier doc_id has, none against another;
extra columns stay out of the spans; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, fresh, hash_windows, hash_words, heavy, join_spread, mark_of, ranges, save, shuffle_partitions, split_words, text_mark, text_runs

WINDOW, GRAM, HOT, SHARD_WORDS, BATCH_BYTES = 50, 10, 20_000, 20_000, 1 << 20


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive values."""
    out, width = x, 1
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (k - width)], out[k - width :]) if width < k else out


def window_keys(data: np.ndarray, offsets: np.ndarray, window: int, gram: int = GRAM):
    """(word starts, word ends, first words, word hashes, windows' first words, their keys) of the rows of a run; a key is the least hash of the window's grams."""
    starts, ends, first = split_words(data, offsets, SPACED)
    words = hash_words(data, starts, ends)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    at = ranges(first[:-1], counts)
    grams = hash_windows(words, min(gram, window))
    keys = sliding_min(grams, window - min(gram, window) + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return starts, ends, first, words, at, keys


def keys_of(docs: DataFrame, window: int) -> DataFrame:
    """(key, doc): the distinct keys of each document."""

    def work(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_runs(b.column(1)):
                *_, first, _, at, keys = window_keys(data, offsets, window)
                if len(at):
                    doc = np.searchsorted(first, at, "right") - 1
                    change = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))
                    found = np.unique(np.stack([keys[change], doc[change].astype(np.uint64)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int64)), pa.array(ids[i + found[:, 1].astype(np.int64)])], names=["key", "doc"])

    return docs.mapInArrow(work, "key long, doc long")


SPANS = "bid long, docs binary, starts binary, sizes binary, keys binary, words binary"


def candidate_spans(docs: DataFrame, window: int) -> DataFrame:
    """Batches of spans of windows under shared keys; docs: (doc, text, keys binary). Starts have the row's text_mark above their 32 bits."""

    def flush(rows: list) -> pa.RecordBatch:
        blobs = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)]
        name = xxhash.xxh3_64_intdigest(b"".join(x.tobytes() for x in blobs)) >> 1
        words = b"\n".join(r[4] for r in rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64())] + [pa.array([x], pa.binary()) for x in (*(x.tobytes() for x in blobs), b"".join(r[3].tobytes() for r in rows), words)],
            names=[c.split()[0] for c in SPANS.split(", ")],
        )

    def work(batches):
        rows, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            shared = b.column(2).to_pylist()
            for i, j, data, offsets in text_runs(b.column(1)):
                starts, ends, first, _, at, keys = window_keys(data, offsets, window)
                raw = data.tobytes()
                lo = 0
                for d in range(i, j):
                    n = max(int(first[d - i + 1] - first[d - i]) - window + 1, 0)
                    own, own_keys = at[lo : lo + n], keys[lo : lo + n]
                    lo += n
                    if not n:
                        continue
                    hit = np.isin(own_keys, np.frombuffer(shared[d], np.uint64))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    base = mark_of(raw[offsets[d - i] : offsets[d - i + 1]]) << 32 if len(edges) else 0
                    for a, z in zip(edges[::2], edges[1::2]):
                        s, e = own[a], own[z - 1] + window
                        text = b" ".join(raw[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist()))
                        rows.append((ids[d], base + int(s - first[d - i]), int(e - s), own_keys[a:z], text))
                        size += len(text)
                    if size >= BATCH_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
        if rows:
            yield flush(rows)

    return docs.mapInArrow(work, SPANS)


class Batch:
    """The spans of a row of SPANS, their windows side by side."""

    def __init__(self, row: dict, window: int):
        self.docs, self.starts, self.sizes = (np.frombuffer(row[k], np.int64) for k in ("docs", "starts", "sizes"))
        self.keys = np.frombuffer(row["keys"], np.uint64)
        self.words = row["words"]
        data = np.frombuffer(self.words, np.uint8)
        self.begin, self.end, _ = split_words(data, np.array([0, len(data)]), SPACED)
        first = np.cumsum(self.sizes) - self.sizes
        counts = self.sizes - window + 1
        self.at = ranges(first, counts)  # first word of each window
        self.span = np.repeat(np.arange(len(counts)), counts)
        self.place = self.at - first[self.span] + self.starts[self.span]  # in its document
        self.hashes = hash_windows(hash_words(data, self.begin, self.end), window)[self.at]


def repeated(spans: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bid, hashes): the window hashes of each batch that occur in several documents; equal rows of a batch count once."""

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                batch = Batch(row, window)
                order = np.lexsort((batch.docs[batch.span], batch.hashes))
                h, d = batch.hashes[order], batch.docs[batch.span][order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                several = d[first] != d[np.append(first[1:], len(h)) - 1]
                h = h[first]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                filled, at = np.unique(bucket[by], return_index=True)
                got = [(k, row["bid"], h[by[i:j]].tobytes(), np.packbits(several[by[i:j]]).tobytes()) for k, i, j in zip(filled.tolist(), at, np.append(at[1:], len(by)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "bid", "hashes", "several"])

    def answer(t: pa.Table) -> pa.Table:
        bids = t.column("bid").to_pylist()
        lists = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(t.column("several").to_pylist(), lists)]
        h, n = np.unique(np.concatenate(lists), return_counts=True)
        many = n > 1
        many[np.searchsorted(h, np.concatenate([x[s] for x, s in zip(lists, several)]))] = True
        found = h[many]
        out = [x[found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x] if len(found) else x[:0] for x in lists]
        return pa.table({"bid": pa.array(bids, pa.int64()), "hashes": pa.array([x.tobytes() for x in out], pa.binary())})

    asked = spans.mapInArrow(ask, "bucket int, bid long, hashes binary, several binary").dropDuplicates(["bucket", "bid"])
    # A bucket holds a hash once for each batch at most, and hashes are even.
    return asked.groupBy("bucket").applyInArrow(answer, "bid long, hashes binary").where(F.length("hashes") > 0)


PIECES = "key long, piece binary, doc long, start long, n int, text binary"


def pieces(spans: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Pieces of the passages: runs of repeated windows under one key; text only once for each piece of a batch, at its smallest doc."""
    answers = found.groupBy("bid").agg(F.collect_list("hashes").alias("found"))  # a group is one batch's buckets

    def work(batches):
        for b in batches:
            for row in b.to_pylist():
                batch = Batch(row, window)
                known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in row["found"]]))
                live = known[np.minimum(np.searchsorted(known, batch.hashes), len(known) - 1)] == batch.hashes
                at = np.flatnonzero(live)
                if not len(at):
                    continue
                new = np.concatenate(([True], (np.diff(at) > 1) | (batch.span[at[1:]] != batch.span[at[:-1]]) | (batch.keys[at[1:]] != batch.keys[at[:-1]])))
                first = at[np.flatnonzero(new)]
                counts = np.diff(np.append(np.flatnonzero(new), len(at)))
                rows, best = [], {}
                for w, n in zip(first.tolist(), counts.tolist()):
                    a = batch.at[w]
                    text = batch.words[batch.begin[a] : batch.end[a + n - 1 + window - 1]]
                    piece = xxhash.xxh3_128_digest(text)
                    doc = int(batch.docs[batch.span[w]])
                    rows.append((int(batch.keys[w].astype(np.int64)), piece, doc, int(batch.place[w]), n, None))
                    if piece not in best or doc < best[piece][0]:
                        best[piece] = (doc, len(rows) - 1, text)
                for _, i, text in best.values():
                    rows[i] = (*rows[i][:5], text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=[c.split()[0] for c in PIECES.split(", ")])

    return spans.join(answers, "bid").mapInArrow(work, PIECES)


class Automaton:
    """A suffix automaton of word sequences that come in ascending order of their documents; each state knows the first document of its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, link: int, moves: dict, first: int | None) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # another sequence has been here
                if length[q] != length[last] + 1:
                    q = self._split(last, w, q)
                last = q
            else:
                cur = self._state(length[last] + 1, 0, {}, None)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[p] + 1 == length[q] else self._split(p, w, q)
                last = cur
            p = last
            while p != -1 and first[p] is None:  # suffixes seen before have an earlier document
                first[p] = doc
                p = link[p]

    def _split(self, p: int, w, q: int) -> int:
        """A state for the words up to w from p, of which q then holds the longer ones only."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nxt[q]), self.first[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def statistics(self, words: list, window: int) -> tuple[list[int], list[int | None]]:
        """Matching statistics: at each word, how many words up to it are in the automaton (those beyond `window` may be left
        out of the count) and, where they are a window, the first document that has it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, n = 0, 0
        lengths, docs = [], []
        for w in words:
            while state and w not in nxt[state]:  # a shorter match may go on
                state = link[state]
                n = length[state]
            to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
                while length[link[state]] >= window:
                    state = link[state]
                    n = length[state]
            lengths.append(n)
            docs.append(first[state] if n >= window else None)
        return lengths, docs


def answers(distinct: DataFrame, window: int) -> DataFrame:
    """(piece, firsts binary): for each window of each distinct piece (shard, piece, doc, text) the smallest document that has it."""

    def work(t: pa.Table) -> pa.Table:
        a, t = Automaton(), t.sort_by([("doc", "ascending"), ("piece", "ascending")])
        out = []
        for text, doc in zip(t.column("text").to_pylist(), t.column("doc").to_pylist()):
            words = text.split()
            found = a.statistics(words, window)[1][window - 1 :]
            if None in found:
                a.add(words, doc)
            out.append(np.array([doc if x is None else x for x in found], np.int64).tobytes())
        return pa.table({"piece": t.column("piece"), "firsts": pa.array(out, pa.binary())})

    return distinct.groupBy("shard").applyInArrow(work, "piece binary, firsts binary")


def recut(pieces_: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, piece, of, at, doc, n, text): pieces (piece, doc, text) cut into runs of windows under one key of longer grams; `at` orders those of a piece."""

    def work(batches):
        for b in batches:
            for piece, doc, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = np.frombuffer(text, np.uint8)
                starts, ends, _, _, at, keys = window_keys(data, np.array([0, len(data)]), window, gram)
                cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(at)]))
                rows = [(int(keys[i].astype(np.int64)), piece, int(i), doc, int(j - i), text[starts[i] : ends[j - 1 + window - 1]]) for i, j in zip(cuts[:-1], cuts[1:])]
                cols = zip(*[(k, xxhash.xxh3_128_digest(x), of, i, d, n, x) for k, of, i, d, n, x in rows])
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "piece", "of", "at", "doc", "n", "text"])

    return pieces_.select("piece", "doc", "text").mapInArrow(work, "key long, piece binary, of binary, at int, doc long, n int, text binary")


def first_documents(distinct: DataFrame, window: int, hot: int, gram: int = GRAM) -> DataFrame:
    """(piece, firsts binary) as answers, for distinct pieces (key, piece, doc, text, n) whose keys are of `gram` words. Keys with over `hot` words of different pieces are cut again."""
    words = F.sum(F.col("n") + (window - 1))
    shards = 1 + int((distinct.agg(words).first()[0] or 0) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    if gram >= window:
        return answers(distinct.select(shard, "piece", "doc", "text"), window)
    sizes = save(distinct.groupBy("key").agg(words.alias("size"), F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("size") > hot).select("key", F.lit(True).alias("large"))
    if not large.take(1):
        return answers(distinct.select(shard, "piece", "doc", "text"), window)
    marked = save(join_spread(distinct, sizes.select("key").join(large, "key", "left"), "key", heavy(sizes, "key"), ["piece"]), "marked")
    longer = min(2 * gram, window)
    cut = save(recut(marked.where("large"), window, longer), "recut")
    again = save(cut.groupBy("key", "piece").agg(F.min("doc").alias("doc"), F.any_value("text").alias("text"), F.any_value("n").alias("n")), "distinct")
    found = first_documents(again, window, hot, longer)
    # A group is one piece's parts.
    shared = heavy(cut.groupBy("piece").agg(F.count("*").alias("n")), "piece")
    gathered = join_spread(cut.select("of", "at", "piece"), found, "piece", shared, ["of", "at"]).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("at", "firsts"))).alias("parts"))
    whole = gathered.select(F.col("of").alias("piece"), F.to_binary(F.array_join(F.transform("parts", lambda p: F.hex(p["firsts"])), ""), F.lit("hex")).alias("firsts"))
    return answers(marked.where("large is null").select(shard, "piece", "doc", "text"), window).unionByName(whole)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int | None = None) -> DataFrame:
    """(doc, mark, spans binary): for each document that loses words, pairs of first word and length, in order; mark tells texts of a doc_id apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    keys = save(keys_of(rows, window), "keys")
    shared = save(keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n"), "shared")
    # A group is one document's keys.
    per_doc = join_spread(keys, shared.select("key"), "key", heavy(shared, "key"), ["doc"]).groupBy("doc").agg(F.collect_set("key").alias("keys"))

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, np.int64).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["doc", "keys"])

    spans = save(candidate_spans(rows.join(per_doc.mapInArrow(packed, "doc long, keys binary"), "doc").select("doc", "text", "keys"), window), "spans")
    total = spans.agg(F.sum(F.length("keys")) / 8).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(total // 500_000) + 1)
    found = save(pieces(spans, repeated(spans, window, buckets), window), "pieces")
    # Text comes with the smallest document of each batch; the smallest of all is among them.
    distinct = found.where("text is not null").groupBy("key", "piece").agg(F.min("doc").alias("doc"), F.any_value("text").alias("text"), F.any_value("n").alias("n"))
    firsts = first_documents(save(distinct, "distinct"), window, HOT if hot is None else hot)

    def lost(batches):
        for b in batches:
            docs, starts, got = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for doc, start, x in zip(docs, starts, got):
                gone = np.concatenate(([0], (np.frombuffer(x, np.int64) < doc).astype(np.int8), [0]))
                edges = np.flatnonzero(np.diff(gone))
                out += [(doc, start + int(a), int(z - a) + window - 1) for a, z in zip(edges[::2], edges[1::2])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "start", "length"])

    places = found.select("doc", "start", "piece").distinct()
    parts = join_spread(places, firsts, "piece", heavy(found.groupBy("piece").agg(F.count("*").alias("n")), "piece"), ["doc", "start"]).select("doc", "start", "firsts").mapInArrow(lost, "doc long, start long, length long")

    def merge(batches):
        for b in batches:
            merged = []
            for spans in b.column(2).to_pylist():
                out = []
                for s in spans:  # sorted by start
                    if out and s["start"] <= out[-1][0] + out[-1][1]:
                        out[-1][1] = max(out[-1][1], s["start"] + s["length"] - out[-1][0])
                    else:
                        out.append([s["start"], s["length"]])
                merged.append(np.array(out, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, pa.binary())], names=["doc", "mark", "spans"])

    place = F.col("start").bitwiseAND(F.lit((1 << 32) - 1)).alias("start")
    # A group is one document's spans.
    return parts.groupBy("doc", F.shiftright("start", 32).alias("mark")).agg(F.sort_array(F.collect_list(F.struct(place, "length"))).alias("spans")).mapInArrow(merge, "doc long, mark long, spans binary")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out: str = "removed_spans", hot: int | None = None) -> DataFrame:
    """docs and a column of spans, null for documents that lose nothing."""
    key, mark = fresh(docs, "_doc"), fresh(docs, "_mark")
    spans = removed_spans(docs, id_col, text_col, window, hot).select(F.col("doc").alias(key), F.col("mark").alias(mark), F.col("spans").alias(out))
    return docs.join(spans, (docs[id_col].cast("long") == F.col(key)) & (text_mark(docs[text_col]) == F.col(mark)), "left").drop(key, mark)


def kept_words(text: str | None, spans: bytes | None) -> tuple[list[bytes], int]:
    """(words that stay, words in all)."""
    words = (text or "").encode().split()
    if not spans:
        return words, len(words)
    keep = np.ones(len(words), bool)
    for start, n in np.frombuffer(spans, np.int64).reshape(-1, 2):
        keep[start : start + n] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()], len(words)


def op10_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches):
        for b in batches:
            kept = [(n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()) for words, n in (kept_words(t.as_py(), s.as_py()) for t, s in zip(b.column(1), b.column(2)))]
            cols = list(zip(*kept)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs).select("doc_id", "text", "removed_spans").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50
),
gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id
),
lost AS (SELECT DISTINCT doc_id, p FROM gone, LATERAL (SELECT unnest(range(i, i + 50)) AS p)),
kept AS (
  SELECT d.doc_id, count(*) FILTER (WHERE lost.p IS NULL) AS n_kept, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE lost.p IS NULL) AS kept
  FROM d, LATERAL (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) AS words
  LEFT JOIN lost ON lost.doc_id = d.doc_id AND lost.p = words.p GROUP BY d.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
