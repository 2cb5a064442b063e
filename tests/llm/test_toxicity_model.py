"""The toxicity model against a plain forward pass, a numerical gradient, and training by hand."""

import numpy as np
import pytest

from tickforge.llm import toxicity as T

from .cases import prose

TEXTS = ["One two, THREE four! five", "", " \t", "one", "été--x naïve 中文 (two) 'three'", prose(60, 3), "a b a b a b a", "!!! ??? one two"]


def features(word):
    """Buckets of a word's n-grams and of itself, from the module's hashes one word at a time."""
    return T.features([word])[1].tolist()


def plain_top(text, per_bucket, span=T.SPAN):
    words = [T.clean_word(w) for w in text.encode().split()]
    scores = [np.mean([per_bucket[b] for b in features(w)]) for w in words]
    spans = [scores[i : i + span] for i in range(max(1, len(scores) - span + 1))] if scores else []
    return max((np.mean(s) for s in spans), default=np.nan)


def test_features_of_a_word():
    """Marks at its ends, all grams of 3 to 6 bytes, and itself; alike wherever the word stands."""
    for w in (b"", b"a", b"word", b"caf\xc3\xa9s"):
        n = len(w) + 2
        assert len(features(w)) == 1 + sum(max(0, n - k + 1) for k in T.GRAMS)
    own, at = T.features([b"word", b"sword", b"word"])
    assert sorted(at[own == 0]) == sorted(at[own == 2]) == sorted(features(b"word"))
    assert set(features(b"word")) & set(features(b"sword")) and set(features(b"word")) != set(features(b"sword"))


def test_forward_pass():
    per_bucket = np.random.default_rng(1).normal(size=T.BUCKETS).astype(np.float32)
    want = [plain_top(t, per_bucket) for t in TEXTS]
    scorer = T.Scorer(T.Model(per_bucket, 0.3, 2.0, 0.25))
    got = scorer.tops([t.encode() for t in TEXTS])
    assert got == pytest.approx(want, rel=1e-5, nan_ok=True)
    assert scorer.tops([TEXTS[5].encode()])[0] == pytest.approx(want[5], rel=1e-5)  # words are known by now
    p = scorer.model.probability(got)
    assert p == pytest.approx([0.25 if np.isnan(x) else 1 / (1 + np.exp(-2 * x - 0.3)) for x in want], rel=1e-5)
    known = [t for t in TEXTS if t.split()]
    sample = T.Sample([t.encode() for t in known])
    assert sample.tops(per_bucket) == pytest.approx([plain_top(t, per_bucket) for t in known], rel=1e-4)


def test_gradient_is_the_numerical_one():
    rng = np.random.default_rng(2)
    sample = T.Sample([t.encode() for t in TEXTS if t])
    per_bucket = rng.normal(size=T.BUCKETS)
    of_spans = rng.normal(size=len(sample.doc))
    got = sample.gradient(of_spans)
    for k in rng.choice(len(sample.used), 40, replace=False):
        up, down = per_bucket.copy(), per_bucket.copy()
        up[sample.used[k]] += 1e-3
        down[sample.used[k]] -= 1e-3
        assert got[k] == pytest.approx(((sample.logits(up) - sample.logits(down)) * of_spans).sum() / 2e-3, abs=1e-4)


def test_loss_falls_with_its_gradient():
    """In the first phase a step of training goes down the loss of all spans with their document's label."""
    rng = np.random.default_rng(3)
    texts = [f"{prose(8, i)} {'zorgling' if i % 2 else 'tidewater'}".encode() for i in range(20)]
    y = np.arange(20) % 2.0
    sample = T.Sample(texts)

    def loss(per_bucket):
        z = sample.logits(per_bucket)
        return np.mean(np.logaddexp(0, z) - y[sample.doc] * z)

    at = rng.normal(0, 0.05, T.BUCKETS)
    z = sample.logits(at)
    g = sample.gradient((1 / (1 + np.exp(-z)) - y[sample.doc]) / len(z))
    step = at.copy()
    step[sample.used] -= 5 * g
    assert loss(step) < loss(at)
    trained = T.train(sample, y)
    tops = sample.tops(trained)
    assert min(tops[y == 1]) > max(tops[y == 0])


def test_cut_and_scores_are_of_one_kind_of_model(spark):
    """The model that scores is trained on all of the sample; the cut is of models that each left a fold out."""
    texts = [f"{prose(12, i)} {'vilex' + 'abcdefgh'[i % 8] if i % 3 == 0 else 'calm'}" for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    found = sorted((t.encode(), float(i % 3 == 0)) for i, t in enumerate(texts))
    alone = T.train(T.Sample([t for t, _ in found]), np.array([y for _, y in found]), seed=T.FOLDS)
    assert np.allclose(model.buckets, alone, atol=1e-4)
    scored = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert np.mean([(scored[i] >= 0.5) == (i % 3 == 0) for i in range(150)]) > 0.98


def test_training_holds_few_arrays_of_spans():
    """A task's memory: 48 bytes a span at most in the sample's arrays of spans and in a training step together with them."""
    import tracemalloc

    from tickforge.llm import toxicity

    words = [bytes([97 + i, 98 + j, 99]) for i in range(20) for j in range(20)]
    rng = np.random.default_rng(2)
    texts = [b" ".join(words[k] for k in rng.integers(0, 400, 2000)) for _ in range(300)]
    sample = toxicity.Sample(texts)
    spans = len(sample.doc)
    assert sum(x.nbytes for x in (sample.begin, sample.doc, sample.size)) <= 9 * spans
    tracemalloc.start()
    toxicity.train(sample, (np.arange(300) % 2).astype(float), steps=(1, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - 40 * toxicity.BUCKETS * toxicity.DIM <= 48 * spans, (peak, spans)
