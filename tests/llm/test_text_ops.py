"""Line de-duplication, substring de-duplication, SimHash and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tickforge.llm import decontam, line_dedup, simhash, substring_dedup

from .cases import awkward, documents, prose, write

WHITE = " \t\n\x0b\x0c\r"


def lower(b):
    return b.lower() if isinstance(b, bytes) else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in b)


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_word_hashes():
    """Words that a polynomial modulo 2^64 can't tell apart, and the same word at any place."""
    import numpy as np

    from tickforge.llm import common

    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    text = np.frombuffer(f"{thue} {thue.translate(str.maketrans('ab', 'ba'))} x {thue}".encode(), np.uint8)
    starts, ends, _ = common.split_words(text, np.array([0, len(text)]), common.SPACED)
    h = common.hash_words(text, starts, ends).tolist()
    assert h[0] == h[3] and len(set(h)) == 3
    two = np.frombuffer(b"abab", np.uint8)  # rows that end and begin inside a run of letters
    starts, ends, _ = common.split_words(two, np.array([0, 2, 4]), common.SPACED)
    assert common.hash_words(two, starts, ends).tolist() == [common.xxhash.xxh3_64_intdigest(b"ab")] * 2


def test_lines(spark, tmp_path):
    texts = awkward() + [f"common line of the whole corpus\nown {i}" for i in range(60)]
    d = write(spark, tmp_path, documents=documents(spark, texts).repartition(7))
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(line.strip(WHITE)) >= 20:
                holders[lower(line.strip(WHITE))].add(i)
    want = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = [len(k := holders.get(lower(x.strip(WHITE)), ())) >= 3 and i != max(k) for x in lines]
        want.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    got = line_dedup.op4_lines(spark, d)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    kept = line_dedup.drop_lines(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns and kept.count() == len(texts)
    assert {r.doc_id: r.keep_bitmap for r in kept.collect()}[3] == 3
    assert line_dedup.drop_lines(documents(spark, [])).count() == 0


def test_lines_over_range_ends():
    """A key that spans tasks is settled from what each task reports."""
    import numpy as np
    import pyarrow as pa

    def batch(r):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in r], pa.int64()) for k in range(4)], names=["h", "g", "doc", "pos"])

    out = [x for b in line_dedup.stream_range([batch([(1, 1, 9, 0), (2, 2, 9, 1)]), batch([(2, 2, 8, 0)]), batch([(2, 2, 7, 0), (2, 2, 7, 3), (3, 3, 5, 0)])], 3) for x in b.to_pylist()]
    assert [(x["h"], x["doc"], x["pos"]) for x in out if x["tag"] == "d"] == [(2, 8, 0), (2, 7, 0), (2, 7, 3)]
    assert {(x["h"], x["doc"]) for x in out if x["tag"] == "p"} == {(1, 9), (3, 5)}
    out = [x for b in line_dedup.stream_range([batch([(1, 1, 9, 0), (2, 2, 9, 1), (2, 2, 8, 1)]), batch([(2, 2, 7, 0)]), batch([(2, 2, 6, 0)])], 3) for x in b.to_pylist()]
    assert [x["doc"] for x in out if x["tag"] == "s"] == [9, 8, 7] and [x["doc"] for x in out if x["tag"] == "d"] == [8, 7, 6]
    for n in (1, 7, 8, 9, 100):
        dropped = np.array([0, n - 1])
        assert line_dedup.unpack_bitmap(line_dedup.pack_bitmap(dropped), n + 5).tolist() == [k not in (0, n - 1) for k in range(n + 5)]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_substrings(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = awkward() + [prose(20, 100 + i) + " " + prose(55, 50) + " " + prose(9, 200 + i) for i in range(25)]
    ids = [i * 3 for i in range(len(texts))]
    d = write(spark, tmp_path, documents=documents(spark, texts, ids).repartition(5))
    first = {}
    split = [(t or "").encode().split() for t in texts]
    for i, w in zip(ids, split):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, w in zip(ids, split):
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        want.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert rows(substring_dedup.op10_substring(spark, d), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(x[2] for x in want) > 1000
    assert substring_dedup.with_spans(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [0, 150, 400, 1500])
def test_hot_keys_are_cut_again(spark, monkeypatch, hot):
    """A passage in many documents with one word changed here and there: its windows share grams, and many differ. Automata still find the first documents."""
    rng = random.Random(hot)
    base = prose(75, 31).split()
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.choice([3, 20, 40, 60, 70])] = rng.choice("xyz")
        docs.append((3 * i, " ".join(prose(6, 500 + i).split() + words[: rng.randrange(55, 76)])))
    rng.shuffle(docs)
    first = {}
    for i, t in sorted(docs):
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    named = []
    plain = substring_dedup.answers

    def spied(distinct, window):
        found = plain(distinct, window)
        told = distinct.join(found, "piece").select("doc", "firsts").collect()
        named.append(sum(any(x != r.doc for x in np.frombuffer(r.firsts, np.int64)) for r in told))
        return found

    monkeypatch.setattr(substring_dedup, "answers", spied)
    got = {r.doc_id: r.removed_spans for r in substring_dedup.with_spans(documents(spark, [t for _, t in docs], [i for i, _ in docs]), hot=hot).select("doc_id", "removed_spans").collect()}
    for i, t in docs:
        w = t.split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        assert substring_dedup.kept_words(t, got[i])[0] == [x.encode() for k, x in enumerate(w) if k not in gone], i
    assert len(named) == {0: 4, 1500: 1}.get(hot, len(named)) and (hot < 400 or sum(named) > 0), named  # shorter bounds leave windows alone


def test_automaton():
    """Matching statistics of texts that are and that aren't in the automaton."""
    a = substring_dedup.Automaton()
    for text, doc in (("n a n", 1), ("a n a s", 2), ("b a n a n a", 5)):
        a.add(text.split(), doc)
    assert a.statistics("b a n a n a".split(), 3)[1] == [None, None, 5, 2, 1, 2]
    assert a.statistics("a n a s".split(), 2)[1] == [None, 1, 1, 2]
    assert a.statistics("x n a q a n a s s".split(), 9)[0] == [0, 1, 2, 0, 1, 2, 3, 4, 1]
    assert a.statistics("x n a q a n a s s".split(), 3)[1] == [None] * 6 + [2, 2, None]


def test_automaton_against_all_pairs():
    import random

    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randrange(1, 25))] for k in range(6)]
        foreign = [rng.choice("abcd") for _ in range(40)]
        a, k = substring_dedup.Automaton(), rng.randrange(1, 6)
        for doc, t in enumerate(texts):
            a.add(t, doc)
        inside = lambda part, t: any(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1))
        lengths, docs = a.statistics(foreign, k)
        for i in range(len(foreign)):
            longest = max(n for n in range(i + 2) if n == 0 or any(inside(foreign[i + 1 - n : i + 1], t) for t in texts))
            assert min(lengths[i], k) == min(longest, k)
            want = next((d for d, t in enumerate(texts) if inside(foreign[i + 1 - k : i + 1], t)), None) if longest >= k else None
            assert docs[i] == want


def test_simhash(spark, tmp_path):
    base = prose(400, 9, 3000)
    near = [base.replace(" ", " ", 1)] + [" ".join(w if k != 10 + i else "changed" for k, w in enumerate(base.split())) for i in range(12)]
    texts = awkward() + near
    d = write(spark, tmp_path, documents=documents(spark, texts).repartition(4))

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(texts))]
    want = [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, label))]
    assert rows(simhash.op2_simhash(spark, d), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(label) if i == c]
    assert kept.columns == documents(spark, []).columns and simhash.keep_one(documents(spark, [])).count() == 0


def test_anchor_copies_cover():
    """Any two fingerprints within the threshold meet at the home of either."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 300, np.uint64)
    for blocks in (8, 9, 13, 16):
        homes = simhash.anchor_copies(x, blocks, 0)[1][:300]
        r, a = simhash.anchor_copies(y, blocks, 4)
        assert set(zip(range(300), homes.tolist())) <= set(zip(r.tolist(), a.tolist()))


def test_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_HOMES", 4)
    monkeypatch.setattr(simhash, "CELL_COPIES", 16)
    fps = [(1 << i) | (1 << (i + 1)) for i in range(40)] + [(1 << 62) - 1]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.u: r.v for r in simhash.stars(simhash.links(nodes)).collect()}
    assert set(roots) == set(fps[1:-1]) and set(roots.values()) == {3}


def spans_by_hand(words, items):
    hit, own = set(), set()
    for name, b in items:
        n = min(10, len(b))
        for k in range(len(b) - n + 1) if n else ():
            for s in range(len(words) - n + 1):
                if words[s : s + n] == b[k : k + n]:
                    hit |= set(range(s, s + n))
                    own.add(str(name))
    return hit, sorted(own)


def test_decontamination(spark, tmp_path):
    tests = [prose(25, 70, 400), "Tiny item", "", None, prose(12, 71, 400), prose(25, 70, 400)]
    texts = awkward() + [prose(5, 80) + " " + prose(25, 70, 400) + " " + prose(5, 81), "x TINY, item! y", prose(12, 71, 400).upper().replace(" ", "-"), " ".join(prose(25, 70, 400).split()[3:14])]
    bench = spark.createDataFrame([(10 + i, t, 1) for i, t in enumerate(tests)] + [(None, "one", 1)], "item_id long, text string, docs int")
    d = write(spark, tmp_path, documents=documents(spark, texts).repartition(3), benchmark=bench)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [(10 + i, split(t)) for i, t in enumerate(tests)]
    want = []
    for i, t in enumerate(texts):
        hit, own = spans_by_hand(split(t), items)
        want.append((i, len(split(t)), len(hit), len(own), sha(",".join(own)), bool(hit)))
    assert rows(decontam.op5_decontam(spark, d), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(w[5] for w in want) >= 4
    clean = decontam.drop_contaminated(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[5]]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.drop_contaminated(documents(spark, texts), nothing).count() == len(texts)
    assert decontam.drop_contaminated(documents(spark, []), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 3)
    bench = spark.createDataFrame([(i, prose(12, 300 + i, 900)) for i in range(5)], "item_id long, text string")
    docs = documents(spark, [prose(12, 301, 900), prose(12, 304, 900) + " " + prose(12, 300, 900), "clean"])
    got = {r.doc_id: r["items"] for r in decontam.spans(docs, bench).collect()}
    assert got == {0: ["1"], 1: ["0", "4"], 2: []}


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = documents(spark, ["x alpha beta z gamma delta y", "alpha delta", "gamma beta alpha delta"])
    assert [r["items"] for r in decontam.spans(docs, bench, 4, 0).orderBy("doc_id").collect()] == [[], [], []]
    assert [r["items"] for r in decontam.spans(docs, bench, 4, 1).orderBy("doc_id").collect()] == [["1"], [], []]
