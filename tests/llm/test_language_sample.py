"""Operator 8: the training sample, and the model against plain loops."""

import math

import numpy as np
import pytest

from casefile.llm import language_id

ENGLISH = "the house and the garden are old but the river is young number {}"
FRENCH = "la maison et le jardin sont vieux mais la riviere est jeune numero {}"


@pytest.mark.parametrize("ids", [lambda n: None, lambda n: 7, lambda n: n])
def test_rows_of_one_id_are_drawn_one_by_one(spark, ids):
    rows = [(ids(n), (ENGLISH if n % 2 else FRENCH).format(n), "en" if n % 2 else "fr") for n in range(3000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=200)
    assert model.langs == ["en", "fr"]
    langs, _, _ = language_id.judge([ENGLISH.format("x"), FRENCH.format("x")], model)
    assert langs == ["en", "fr"]


def test_every_label_gives_a_row_and_equal_rows_no_more_than_a_share(spark, monkeypatch):
    rows = [(1, ENGLISH, "en")] * 2000 + [(1, FRENCH, "fr")] * 3000 + [(1, "ein altes haus", "de")]
    taken = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda features, labels: taken.extend(labels) or train(features, labels))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=30)
    assert model.langs == ["de", "en", "fr"]
    assert {y: taken.count(y) for y in model.langs} == {"de": 1, "en": 10 + language_id.SPARE_ROWS,
                                                        "fr": 10 + language_id.SPARE_ROWS}


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 2, (language_id.BUCKETS, 3))
    seen = rng.random(language_id.BUCKETS) < 0.7
    model = language_id.Model(["a", "b", "c"], logits, np.array([0.1, -0.2, 0.3]), seen, temperature=1.7)
    texts = ["Une phrase, avec DES mots", "zz", "word " * 50, "日本語", ""]
    best, score, has = model.scores(texts)
    for n, text in enumerate(texts):
        buckets, _, letters = language_id.subwords([text])
        assert bool(has[n]) == bool(letters[0])
        if not letters[0]:
            continue
        mean = [sum(float(logits[b, k]) for b in buckets) / len(buckets) + float(model.bias[k]) for k in range(3)]
        p = softmax([x / 1.7 for x in mean])
        known = sum(bool(seen[b]) for b in buckets) / len(buckets)
        assert best[n] == p.index(max(p)) and score[n] == pytest.approx(max(p) * known)


def test_a_step_of_training_equals_plain_loops():
    """One epoch over one batch: embeddings, weights and bias move against the loss's gradient."""
    rows = [(np.array([1, 5, 9]), np.array([2., 1., 1.], np.float32)), (np.array([5, 7]), np.array([1., 3.], np.float32)),
            (np.array([9]), np.array([4.], np.float32))]
    labels = ["x", "y", "x"]
    model = language_id.train(rows, labels, epochs=1, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    rng.permutation(3)
    embed = rng.normal(0, 0.1, (language_id.BUCKETS, language_id.DIMENSIONS)).astype(np.float32).astype(float)
    weight = rng.normal(0, 0.1, (language_id.DIMENSIONS, 2)).astype(np.float32).astype(float)

    def loss(e, w, b):
        total = 0.0
        for (buckets, counts), label in zip(rows, labels):
            hidden = [sum(c / counts.sum() * e[k, d] for k, c in zip(buckets, counts)) for d in range(e.shape[1])]
            z = [sum(h * w[d, y] for d, h in enumerate(hidden)) + b[y] for y in range(2)]
            total -= math.log(softmax(z)["xy".index(label)])
        return total / len(rows)

    def gradient(array, at, call):
        moved, step = [], 1e-5
        for sign in (1, -1):
            array[at] += sign * step
            moved.append(call())
            array[at] -= sign * step
        return (moved[0] - moved[1]) / (2 * step)

    bias = np.zeros(2)
    call = lambda: loss(embed, weight, bias)
    new_embed, new_weight = embed.copy(), weight.copy()
    for k in (1, 5, 7, 9):
        for d in range(language_id.DIMENSIONS):
            new_embed[k, d] -= 0.5 * gradient(embed, (k, d), call)
    for d in range(language_id.DIMENSIONS):
        for y in range(2):
            new_weight[d, y] -= 0.5 * gradient(weight, (d, y), call)
    new_bias = [-0.1 * 0.5 * gradient(bias, (y,), call) for y in range(2)]  # the bias learns a tenth as fast
    assert model.bias == pytest.approx(new_bias, abs=1e-5)
    assert model.logits[[1, 5, 7, 9]] == pytest.approx((new_embed @ new_weight)[[1, 5, 7, 9]], abs=1e-5)
    assert sorted(np.flatnonzero(model.seen)) == [1, 5, 7, 9]
