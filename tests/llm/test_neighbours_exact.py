"""op1 on rows whose neighbours codes can't tell apart, or that differ from most rows: every query's are the true ones."""

import numpy as np
import pytest

from tickforge.llm import ann

from .cases import write


def rows(kind):
    rng = np.random.default_rng(12)
    n = 6000
    if kind == "ties":  # many vectors at one distance: the smaller ids count
        return rng.integers(0, 2, size=(n, 16)).astype(np.float32)
    x = rng.normal(size=(n, 24))
    if kind == "tight":  # more near copies of one vector than a shortlist holds, all with one code
        x[:900] = x[0] + 1e-3 * rng.normal(size=(900, 24))
    else:  # the queries alone are far out
        x[::100] *= 8
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["ties", "tight", "far queries"])
def test_every_query_finds_its_nearest(spark, tmp_path, kind):
    x = rows(kind)
    d = write(spark, tmp_path, embeddings=spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    got = {}
    for r in ann.op1_ann(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, len(x), 100))
    y = x.astype(float)
    for q, found in got.items():
        dist = np.sqrt(((y - y[q]) ** 2).sum(1))
        dist[q] = np.inf
        assert found == np.lexsort((np.arange(len(x)), dist))[:10].tolist()


def test_lists_that_cannot_matter_are_not_asked(spark):
    """Clustered vectors: the check goes to the own cluster's lists only."""
    rng = np.random.default_rng(9)
    x = (np.repeat(np.eye(6) * 50, 300, axis=0) + rng.normal(size=(1800, 6))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    index = ann.build(vectors, 10)
    queries = vectors.where("id < 300 and id % 20 = 0")
    seen = []
    in_cells = ann.in_cells

    def watched(index, asked, *rest):
        seen.append(asked)
        return in_cells(index, asked, *rest)

    ann.in_cells = watched
    try:
        ann.completed(index, ann.reranked(index, queries, 10), queries, 10).count()
    finally:
        ann.in_cells = in_cells
    bits = np.stack([np.unpackbits(np.frombuffer(r.probes, np.uint8), bitorder="little") for r in seen[-1].collect()])
    own = ann.nearest(x[:300].astype(float), index.model.centers)
    assert not bits[:, np.setdiff1d(np.arange(bits.shape[1]), own)].any()
