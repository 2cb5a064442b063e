"""Decontamination of rows without a doc_id, and of repeated ones."""

import pytest

from tickforge.llm import decontam

from .cases import documents, prose


def test_rows_without_an_id(spark, tmp_path):
    from .cases import write

    bench = spark.createDataFrame([(1, prose(12, 300, 900))], "item_id long, text string")
    docs = documents(spark, [prose(12, 300, 900), "clean", prose(12, 300, 900), "clean too"], [None, None, 3, 3]).repartition(2)
    d = write(spark, tmp_path, documents=docs, benchmark=bench)
    got = decontam.op5_decontam(spark, d).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.contaminated) for r in got) == [(-1, 1, False), (-1, 12, True), (3, 2, False), (3, 12, True)]
    kept = decontam.drop_contaminated(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "clean"), (3, "clean too")]


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_blocks_give_the_same_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    bench = spark.createDataFrame([(i, prose(12, 300 + i, 900)) for i in range(5)], "item_id long, text string")
    one, two = prose(12, 301, 900), prose(12, 304, 900)
    docs = documents(spark, [one, one, two, None, None, one], [7, 7, 7, 8, 8, None]).repartition(2)
    got = sorted((r.doc_id or -1, r.n_words, r["items"]) for r in decontam.spans(docs, bench).collect())
    assert got == [(-1, 12, ["1"]), (7, 12, ["1"]), (7, 12, ["1"]), (7, 12, ["4"]), (8, 0, []), (8, 0, [])]
