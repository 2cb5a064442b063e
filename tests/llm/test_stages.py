"""The pipeline's stages against brute force: exactly the same documents and lines stay; and rows that are awkward."""

import re
from collections import Counter, defaultdict

import corpus_pipeline

from .cases import awkward, documents, prose, write
from .test_near_copies import least_ids
from .test_text_ops import WHITE, lower


def test_toxic_documents_go(spark):
    """Against the labels of a table with junk, menus and shouting, from which the stage learns."""
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, at).select("doc_id").collect()}
    caught = [i not in kept for i, t in labels.items() if t]
    alone = [i in kept for i, t in labels.items() if not t]
    assert sum(caught) >= 0.8 * len(caught) and sum(alone) >= 0.97 * len(alone)


def test_lines_that_repeat_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, holders = docs.select("doc_id", "text").collect(), defaultdict(set)
    key = lambda x: lower(x.strip(WHITE))
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(r.doc_id)
    gone = {k: max(d) for k, d in holders.items() if len(d) >= 3}
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if gone.get(key(x), r.doc_id) == r.doc_id) for r in rows}
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, sf_dir).collect()
    assert {r.doc_id: r.text or "" for r in got} == want and gone
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_kept_documents(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    want = {i for i, c in zip(ids, least_ids([r.text for r in rows], ids)) if i == c}
    docs = stages["simhash_near_dedup"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.select("doc_id").collect()} == want and len(want) < len(set(ids))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null").collect():
        b = split(r.text)
        n = min(10, len(b))
        for k in range(len(b) - n + 1) if n else ():
            grams.setdefault(n, set()).add(tuple(b[k : k + n]))
    clean = set()
    for r in docs.select("doc_id", "text").collect():
        w = split(r.text)
        if not any(tuple(w[k : k + n]) in g for n, g in grams.items() for k in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    got = {r.doc_id for r in stages["decontamination"](spark, docs, sf_dir).select("doc_id").collect()}
    assert got == clean and len(clean) < len(want)


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, clashing columns; and an empty table."""
    test = prose(14, 900, 4000)
    texts = awkward() + [test, "clean " + prose(40, 901, 4000), "clean too " + prose(40, 902, 4000), None]
    ids = [*range(len(texts) - 4), None, None, 0, None]
    tables = {"labels": spark.createDataFrame([(0, 0)], "doc_id long, toxic int"), "benchmark": spark.createDataFrame([(1, test)], "item_id long, text string")}
    at = write(spark, tmp_path, **tables)
    docs = documents(spark, texts, ids).repartition(3)
    columns, last = docs.columns, len(corpus_pipeline.STAGES) - 1
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, at).cache()
        got = docs.collect()
        if k < last:
            assert docs.columns == columns
        if name in ("toxicity", "line_dedup"):
            assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        elif name == "simhash_near_dedup":
            assert all((i, t) in [(r.doc_id, r.text) for r in got] for i, t in rows if i is None)
        elif name == "decontamination":
            assert Counter((r.doc_id, r.text) for r in got) == Counter(x for x in rows if x[1] != test)
        else:
            assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for i, _ in rows)
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, at)
        assert none.count() == 0
