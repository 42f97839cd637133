"""Scores against a plain sum over features, odd rows, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from prefspark.llm import toxicity as T


MASK = (1 << 64) - 1
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def plain_features(text):
    """Indices of words, neighbours and pairs around one word, in whole numbers."""
    words = [zlib.crc32(w.encode()) for w in T._TOKEN.findall((text or "").lower())]
    turned = lambda x: x ^ (x >> 29)
    index = lambda x: (turned(x) * MIX[1] & MASK) >> 44
    found = set()
    for i, word in enumerate(words):
        first = (word + 1) * MIX[0] & MASK
        found.add(index(first))
        for step in (1, 2):
            if i + step < len(words):
                found.add(index(first ^ turned(words[i + step] * MIX[step] & MASK)))
    return found


def plain_logit(model, text):
    dense = model.dense()
    return model.bias + sum(float(dense[k]) for k in plain_features(text))


def plain_ftrl(examples, labels, seed=0):
    """FTRL-proximal by its update rule, coordinate by coordinate; the bias is one more."""
    z, n, bias = {}, {}, "bias"

    def weight(k):
        if abs(z.get(k, 0.0)) <= T.L1:
            return 0.0
        pulled = z[k] - math.copysign(T.L1, z[k])
        return -pulled / ((T.BETA + math.sqrt(n.get(k, 0.0))) / T.ALPHA + T.L2)

    prior = math.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 1.5))
    order = np.random.default_rng(seed)
    for _ in range(T.EPOCHS):
        for i in order.permutation(len(labels)):
            keys = [*examples[i], bias]
            now = {k: weight(k) for k in keys}
            gradient = 1 / (1 + math.exp(-(prior + sum(now.values())))) - labels[i]
            for k in keys:
                before, after = math.sqrt(n.get(k, 0.0)), math.sqrt(n.get(k, 0.0) + gradient**2)
                z[k] = z.get(k, 0.0) + gradient - (after - before) / T.ALPHA * now[k]
                n[k] = n.get(k, 0.0) + gradient**2
    return {k: weight(k) for k in z if k != bias and weight(k)}, prior + weight(bias)


def some_examples():
    random.seed(2)
    texts = [" ".join(random.choices([f"w{i}" for i in range(30)], k=8)) for _ in range(150)]
    labels = [int(i % 3 == 0) for i in range(150)]
    return [t + " ugly foul" * label for t, label in zip(texts, labels)], labels


def test_features_by_their_definition():
    for text in ("", "one", "One two", "a b c a b c d", "ñandú, 漢字! x_1"):
        assert set(T.features(T.word_codes(text)).tolist()) == plain_features(text)


def test_trainer_equals_the_plain_rule():
    texts, labels = some_examples()
    model = T.train([np.unique(T.features(T.word_codes(t))) for t in texts], labels)
    weights, bias = plain_ftrl([plain_features(t) for t in texts], labels)
    found = dict(zip(model.indices.tolist(), model.weights.tolist()))
    assert found.keys() == weights.keys() and len(found) > 5
    assert all(math.isclose(found[k], weights[k], rel_tol=1e-5, abs_tol=1e-6) for k in weights)
    assert math.isclose(model.bias, bias, rel_tol=1e-9)


def test_a_sample_that_holds_all_rows_trains_like_the_rows(spark, docs):
    texts, labels = some_examples()
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    # Three others for each toxic row are wanted and there are two: all rows are taken.
    found = T.fit(docs(list(enumerate(texts))), rows)
    whole = T.train([np.unique(T.features(T.word_codes(t))) for t in texts], labels)
    assert found.indices.tolist() == whole.indices.tolist() and np.allclose(found.weights, whole.weights)
    assert math.isclose(found.bias, whole.bias)


@pytest.fixture(scope="module")
def model():
    random.seed(1)
    calm, rude = [f"w{i}" for i in range(40)], ["ugly", "foul"]
    texts, labels = [], []
    for i in range(400):
        words = random.choices(calm, k=12)
        labels.append(i % 4 == 0)
        if labels[-1]:
            words[random.randrange(12)] = random.choice(rude)
        texts.append(" ".join(words))
    return T.train([np.unique(T.features(T.word_codes(t))) for t in texts], [int(x) for x in labels])


def test_learns_what_marks_the_label_and_little_else(model):
    dense = model.dense()
    assert dense[T.features(T.word_codes("ugly"))[0]] > 1 and dense[T.features(T.word_codes("foul"))[0]] > 1
    assert len(model.indices) < 300


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_chunks_see_all_features(model, monkeypatch, chunk):
    monkeypatch.setattr(T, "_CHUNK", chunk)
    for text in ("", None, "w1", "w1 w2", "ugly w3 w4 w1 ugly w3 w9", "W1, w2! foul"):
        assert math.isclose(model.bias + T._logit(model.dense(), text), plain_logit(model, text), abs_tol=1e-4)


def test_odd_rows(docs, model):
    rows = [(1, None), (2, ""), (3, "an ugly one"), (3, "an ugly one"), (None, "w1 w2"), (4, "w1 " * 400_000)]
    found = T.score(docs(rows).withColumnRenamed("lang", "score"), model)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "score", "predicted"]
    got = {(r["doc_id"], r["predicted"]) for r in found.collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 0), (4, 0)} and found.count() == 6


def test_labels_that_teach_nothing(spark, docs):
    table = docs([(1, "some text"), (2, None)])
    for rows in ([], [(1, None)], [(9, 1)], [(1, 0)], [(None, 1)]):
        model = T.fit(table, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r["predicted"] for r in T.score(table, model).collect()} == {0}


def test_held_out_accuracy(spark):
    from prefspark.llm.queries import op4_toxicity

    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = op4_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    hit, right = found[found["toxic"] == 1]["predicted"].mean(), found[found["predicted"] == 1]["toxic"].mean()
    assert len(found) > 500 and hit > 0.65 and right > 0.9, (hit, right)
