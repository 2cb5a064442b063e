"""Near copies of the pipeline against all pairs' 5-word Jaccard similarity."""

import pyarrow as pa
import pytest

from tickforge.llm import near_copies

from .cases import awkward, documents, prose


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least_ids(texts, ids):
    sets = [shingles(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if x == y or 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    label = list(ids)
    for _ in texts:
        label = [min(label[j] for j in own) for own in near]
    return label


def edited(words, places):
    return " ".join("changed" if k in places else w for k, w in enumerate(words))


@pytest.mark.parametrize("chunk, large", [(256, 4096), (3, 4096), (3, 5)])
def test_near_copies(spark, monkeypatch, chunk, large):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "LARGE", large)
    base = prose(200, 9, 3000).split()
    # Of 196 shingles 5 go with each edit: similarity 0.95 at one, 0.81 at four, 0.77 at five.
    near = [edited(base, {20 * k + 7 + i for k in range(i % 6)}) for i in range(30)]
    texts = awkward() + near + [edited(prose(200, 10, 3000).split(), {20 * k + 9 for k in range(i)}) for i in (5, 0)]
    ids = [3 * i for i in range(len(texts))]
    label = least_ids(texts, ids)
    kept = near_copies.keep_one(documents(spark, texts, ids).repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in zip(ids, label) if i == c]
    assert kept.columns == documents(spark, []).columns and near_copies.keep_one(documents(spark, [])).count() == 0


def test_chunk_cells(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    groups = {g: sorted((k * k % (g + 2), 100 * g + k) for k in range(n)) for g, n in enumerate([1, 4, 5, 9, 30, 23])}
    rows = [(g, len(own), node, label) for g, own in groups.items() for label, node in own]
    expected = []
    for own in groups.values():
        parts = [own[i : i + 4] for i in range(0, len(own), 4)]
        expected += [sorted({*x, *y}) for i, x in enumerate(parts) for y in parts[i:] if len({label for label, _ in x + y}) > 1]
    cells = {}
    for r in near_copies.chunk_cells(spark.createDataFrame(rows, "g long, n long, node long, label long").repartition(5)).collect():
        cells.setdefault(r.cell, []).append((r.label, r.node))
    assert sorted(map(sorted, cells.values())) == sorted(expected)


def test_rows_without_or_with_the_same_id(spark):
    texts = [prose(100, 1), prose(100, 1), prose(100, 2), prose(100, 3), prose(100, 1)]
    kept = near_copies.keep_one(documents(spark, texts, [None, 1, 2, 2, 2]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3])])


def test_sets_are_those_of_whole_texts():
    texts = awkward()
    (i, j, hashes, offsets), *more = near_copies.shingle_sets(pa.array(texts, pa.string()))
    assert not more and (offsets[1:] - offsets[:-1]).tolist() == [len(shingles(t)) for t in texts]


def test_documents_of_a_template_are_hardly_paired(spark, monkeypatch):
    """600 documents that share half their shingles, none a copy but a few: finer keys leave few of them together, and lose no copy."""
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    monkeypatch.setattr(near_copies, "LARGE", 64)
    head = prose(60, 77, 3000)
    texts = [head + " " + prose(40, 1000 + i, 3000) for i in range(600)]
    texts += [edited(texts[7 * i].split(), {80}) for i in range(20)]
    ids = list(range(len(texts)))
    sent, cells = [], near_copies.chunk_cells
    monkeypatch.setattr(near_copies, "chunk_cells", lambda rows: sent.append(found := near_copies.save(cells(rows), "cells")) or found)
    kept = {r.doc_id for r in near_copies.keep_one(documents(spark, texts, ids)).select("doc_id").collect()}
    assert kept == set(range(600))
    counted = sent[0].groupBy("cell").count().collect()
    assert sum(r["count"] for r in counted) < 620 * 40, "all pairs of 39 chunks would send each of 620 members to 39 cells, for each of its groups"
