"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickforge.llm import periodic_runs as P

from .cases import SCHEMA, awkward, write


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def wanted(doc_id, text):
    w = planted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    runs = brute(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else (None,) * 3
    place = (s, e - s, q, 1000 * (e - s) // q) if runs else (None,) * 4
    return doc_id, len(runs), *place, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def words(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.5 and n > 6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_of_words(least):
    rng = random.Random(least)
    for _ in range(1500):
        w = words(rng, rng.randrange(70), rng.choice([1, 2, 3, 4, 9]))
        assert P.runs_of(w, least) == brute(w, least), w
    fib = [0], [0, 1]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    assert P.runs_of(fib[1], least) == brute(fib[1], least)


def test_factors_are_longest_earlier_occurrences():
    rng = random.Random(3)
    for _ in range(300):
        w = words(rng, rng.randrange(1, 40), 3)
        at = 0
        for s, e, source in P.factors(w):
            earlier = [j for j in range(s) if w[j : j + e - s] == w[s:e]]
            assert s == at and (source in earlier if source >= 0 else not earlier and e == s + 1)
            assert e == len(w) or not any(w[j : j + e + 1 - s] == w[s : e + 1] for j in range(s))
            at = e
        assert at == len(w)


def test_stretches_lose_no_run():
    rng = random.Random(4)
    for _ in range(600):
        rows = [words(rng, rng.randrange(90), rng.choice([2, 3, 8, 60])) for _ in range(rng.randrange(1, 5))]
        first = np.concatenate(([0], np.cumsum([len(w) for w in rows]))).astype(int)
        least = rng.choice([2, 3, 5, 12])
        got = P.document_runs(np.array(sum(rows, []), np.int64), first, least)
        assert got == {i: b for i, w in enumerate(rows) if (b := brute(w, least))}


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = awkward()
    texts += [" \t".join(f"w{x}é" for x in words(rng, rng.randrange(300), rng.choice([2, 5, 40, 4000]))) + "\n" for _ in range(150)]
    texts += ["again " * 5000, "a b " * 700 + "c", texts[-1], texts[-1]]
    ids = [*range(len(texts) - 3), 9, None, None]
    rows = [(i, t, "en", "s", 1, 7, "x", 1, 2, "?", 3, 4) for i, t in zip(ids, texts)]
    d = write(spark, tmp_path, documents=spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = P.op13_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(wanted(i, t) for i, t in zip(ids, texts))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    free = P.with_runs(docs, out="key2").where("text like 'a b %'").first()
    assert [tuple(x) for x in free.key2_spans] == [(0, 1400, 2)] and free.key2.exponent_milli == 700_000 and free.score == "?"


def test_empty_table(spark, tmp_path):
    d = write(spark, tmp_path, documents=spark.createDataFrame([], SCHEMA))
    assert P.op13_runs(spark, d).count() == 0
