"""Rows without an id, repeated rows with equal and with other texts, and empty tables, through every operator's query."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tickforge.llm import common, katz, line_dedup, packing, simhash, substring_dedup, token_store, tokens, toxicity, warc

from .cases import documents, prose, write

LINE = "a line that is long enough to count"
LONG = prose(80, 30, 500)
TEXTS = [f"{LINE}\nx", f"y\n{LINE}", f"z\n{LINE}", f"z\n{LINE}", f"{LINE}\nown line of the second text", None, "", f"{LINE}", LONG, "before " + LONG, LONG + " after", LONG]
IDS = [None, None, 3, 3, 3, 5, 7, 9, 11, 11, 13, None]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    at = tmp_path_factory.mktemp("rows")
    return write(spark, at, documents=documents(spark, TEXTS, IDS).repartition(3), labels=labels)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id long, toxic int"))


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_simhash(spark, where):
    got = counted(simhash.op2_simhash(spark, where), "doc_id", "fingerprint")
    assert got == Counter((i, f"{simhash.fingerprint((t or '').encode()):016x}") for i, t in zip(IDS, TEXTS))
    least = {r.fingerprint: r.component_id for r in simhash.op2_simhash(spark, where).collect()}
    assert least[f"{simhash.fingerprint(LONG.encode()):016x}"] == 11


def test_token_store(spark, where):
    e = tokens.encoder(tokens.default_path("word_bpe_49k.json"), "word")
    want = [np.append(np.frombuffer(x, np.uint16), 2).astype("<u4") for x in e.encode([(t or "").encode() for t in TEXTS])]
    got = token_store.op3_token_store(spark, where).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(w), zlib.crc32(w.tobytes())) for i, w in zip(IDS, want))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(IDS, key=lambda i: -1 if i is None else i)


def test_lines(spark, where):
    """Four documents hold the line: none, 3 and 9; it stays in 9, and each row loses lines of its own text."""
    got = counted(line_dedup.op4_lines(spark, where), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = Counter()
    for i, t in zip(IDS, TEXTS):
        lines = (t or "").split("\n")
        kept = lines if i == 9 else [x for x in lines if x != LINE]
        want[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    assert got == want


def test_substrings(spark, where):
    words = [(t or "").split() for t in TEXTS]
    first = {}
    for i, w in zip(IDS, words):
        for k in range(len(w) - 49) if i is not None else ():
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = Counter()
    for i, w in zip(IDS, words):
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        want[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert counted(substring_dedup.op10_substring(spark, where), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    docs = documents(spark, [LONG, "x y", LONG + " tail"], [1, 2, 2])
    assert counted(substring_dedup.with_spans(docs).selectExpr("doc_id", "text", "removed_spans is null as whole"), "text", "whole") == Counter([(LONG, True), ("x y", True), (LONG + " tail", False)])


def test_packing(spark, where):
    got, want = Counter(), Counter()
    for r in packing.op9_packing(spark, where).collect():
        got[r.doc_id] += r.length
    for i, ids in zip(IDS, tokens.encoder(tokens.default_path("byte_bpe_50k.json"), "byte").encode([(t or "").encode() for t in TEXTS])):
        want[i] += len(ids) // 2 + 1
    assert got == want


def test_scores(spark, where):
    """Equal texts score alike, whatever their ids; every row comes back."""
    by_text = {}
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{where}/labels.parquet"))
    for r in toxicity.score(docs, model, out="s").collect():
        by_text.setdefault(r.text, set()).add(r.s)
    assert all(len(s) == 1 for s in by_text.values()) and toxicity.op7_toxicity(spark, where).count() == len(TEXTS)
    got = counted(katz.op8_katz(spark, where), "doc_id", "n_tokens")
    assert got == Counter((i, len((t or "").split()) + 1) for i, t in zip(IDS, TEXTS))
    remainder = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in IDS if i is not None} | {None: False}
    assert all(r.held_out == remainder[r.doc_id] for r in katz.op8_katz(spark, where).collect())


def test_archives(spark, tmp_path):
    long, other = "é" * 30_000, "z" * 40_000
    html = [(1, long), (1, other), (1, long), (2, long), (2, other), (2, "short"), (3, other), (None, long)]
    d = write(spark, tmp_path, pages=spark.createDataFrame([(i, f"u{k}", h) for k, (i, h) in enumerate(html)], "page_id long, url string, html string").repartition(3))
    got = counted(warc.op6_warc(spark, d), "page_id", "payload_digest", "record_type", "refers_to")
    want = Counter((i, sha(h), "response" if i == 1 or h == "short" else "revisit", None if i == 1 or h == "short" else 1) for i, h in html if i)
    assert got == want


def test_empty_tables(spark, nothing):
    for query in (simhash.op2_simhash, token_store.op3_token_store, line_dedup.op4_lines, toxicity.op7_toxicity, katz.op8_katz, packing.op9_packing, substring_dedup.op10_substring):
        assert query(spark, nothing).count() == 0


def test_hot_rows_are_spread(spark):
    left = spark.createDataFrame([(7, i) for i in range(3000)] + [(8, 1), (9, 2)], "k long, i long")
    right = spark.createDataFrame([(7, "a"), (8, "b"), (10, "c")], "k long, v string")
    hot = common.heavy(left.groupBy("k").agg(common.F.count("*").alias("n")), "k")
    assert [r.k for r in hot.collect()] == [7]
    got = common.join_spread(left, right, "k", hot, ["i"])
    assert got.columns == ["k", "i", "v"] and Counter(r.v for r in got.collect()) == {"a": 3000, "b": 1}
