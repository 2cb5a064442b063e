"""Packing: the full order of scores, statistics of whole documents, and neighbours over many shards."""

import random
from collections import Counter, defaultdict

import numpy as np

from tickforge.llm import packing, tokens

from .cases import documents


def test_full_order_of_scores():
    """Windows of many short remainders: those of the seed's topic, however many and wherever they stand."""
    rng = np.random.default_rng(5)
    topic = np.repeat([0, 1], [200, 200])[rng.permutation(400)]
    ids = [np.append(1 + t, np.arange(4) + 100 + 4 * i) for i, t in enumerate(topic.tolist())]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=2000)
    windows = packing.fill(ids, packing.Shard(ids, df, 400, 5.0), 500)
    assert [len({topic[r] for r, _, _ in w}) for w in windows] == [1, 1, 1, 1]


def test_windows_follow_brute_force_bm25():
    """One shard: seeds in order, and for each the unused remainders by BM25, cut only where none fits."""
    rng = np.random.default_rng(9)
    ids = [rng.integers(0, 60, rng.integers(3, 40)) for _ in range(70)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=60)
    mean, window = float(np.mean([len(x) for x in ids])), 100
    idf = [np.log(1 + (70 - d + 0.5) / (d + 0.5)) for d in df]

    def bm25(seed, other):
        return sum(round(packing.STEPS * idf[t] * (n := (other == t).sum()) * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(other) / mean))) for t in set(seed.tolist()) if (other == t).any())

    left, want = {i: (0, len(x)) for i, x in enumerate(ids)}, []
    while left:
        seed = min(left)
        at, n = left.pop(seed)
        own, space = [(seed, at, n)], window - n
        ranked = sorted(left, key=lambda r: (-bm25(ids[seed], ids[r]), r))
        for r in ranked:
            if left[r][1] <= space:
                own.append((r, *left[r]))
                space -= left.pop(r)[1]
        rest = [r for r in ranked if r in left]
        if space and rest:
            at, n = left[rest[0]]
            own.append((rest[0], at, space))
            left[rest[0]] = (at + space, n - space)
        want.append(own)
    got = packing.fill(ids, packing.Shard(ids, df, 70, mean), window)
    assert got == want


def test_all_ids_of_the_seed_count():
    seed = np.arange(200)
    many, few = np.arange(60, 200), np.arange(0, 50)  # the heaviest 32 ids of the seed are among the few
    df = np.where(np.arange(400) < 50, 2, 3)
    index = packing.Shard([seed, np.concatenate([few, np.arange(210, 300)]), many, many], df, 100, 140.0)
    score = index.scores(0)
    assert score[2] == score[3] > score[1] > 0


def test_statistics_are_of_whole_documents(spark):
    path = tokens.default_path("byte_bpe_50k.json")
    vocab = tokens.encoder(path, "byte").library.get_vocab_size()
    texts = ["left " * 40 + "right", "right", "left", None]
    found = packing.pieces(documents(spark, texts).repartition(2), path, "byte", 1, vocab, window=16)
    df, n, mean, tails = packing.frequencies(found, vocab)
    whole = [np.frombuffer(x, np.uint16).tolist() + [1] for x in tokens.encoder(path, "byte").encode([(t or "").encode() for t in texts])]
    assert dict(enumerate(df)) == dict.fromkeys(range(vocab), 0) | Counter(t for w in whole for t in set(w))
    assert (n, mean, tails) == (4, sum(map(len, whole)) / 4, sum(len(w) % 16 > 0 for w in whole))


def topics(n, each):
    rng = random.Random(1)
    words = [["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(30)] for _ in range(n)]
    rows = [(k, " ".join(rng.choices(words[k], k=20))) for k in range(n) for _ in range(each)]
    rng.shuffle(rows)
    return rows


def test_neighbours_meet_over_many_shards(spark):
    rows = topics(12, 40)
    docs = documents(spark, [t for _, t in rows]).repartition(3)
    got = packing.pack(docs, tokens.default_path("byte_bpe_50k.json"), "byte", 1, 512, shard=40).collect()
    windows, taken = defaultdict(Counter), Counter()
    for r in got:
        windows[r.sequence_id][rows[r.doc_id][0]] += r.length
        taken[r.doc_id] += r.length
    assert len(taken) == len(rows) and sum(max(w.values()) for w in windows.values()) > 0.8 * sum(taken.values())


def test_hot_id_is_spread(spark):
    rows = topics(3, 200)
    path = tokens.default_path("byte_bpe_50k.json")
    vocab = tokens.encoder(path, "byte").library.get_vocab_size()
    found = packing.pieces(documents(spark, [t for _, t in rows], [None] * len(rows)), path, "byte", 1, vocab).cache()
    df, n, _, tails = packing.frequencies(found, vocab)
    dealt, shards = packing.deal(found.where("length >= 0"), df, n, tails, 50, 2)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 100 and len(sizes) <= shards


def test_equal_rows_are_spread(spark):
    """3,000 equal rows without an id and 600 others."""
    rows = [t for _, t in topics(3, 200)] + ["the same few words in every one of these rows"] * 3000
    path = tokens.default_path("byte_bpe_50k.json")
    vocab = tokens.encoder(path, "byte").library.get_vocab_size()
    found = packing.pieces(documents(spark, rows, [None] * len(rows)), path, "byte", 1, vocab).where("true")
    df, n, _, tails = packing.frequencies(found, vocab)
    dealt, shards = packing.deal(found.where("length >= 0"), df, n, tails, 50, 2)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert sum(sizes) == 3600 and max(sizes) <= 130 and len(sizes) <= shards
