import random
import zlib

import numpy as np
import pytest

from chainlens.llm import toxicity_ftrl as T
from tests.llm.common import COLUMNS, frame, prose, save

INSULTS = ["gruff", "snark", "blort", "wretch"]


def labelled(spark, n, seed=1):
    """Every fourth document holds an insult, or two plain words with one word between them."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r.randint(5, 80), i + seed).split()
        toxic = i % 4 == 0
        if toxic:
            at = r.randrange(len(words) + 1)
            words[at:at] = [r.choice(INSULTS)] if i % 8 else ["you", r.choice(words), "thing"]
        else:
            words.insert(r.randrange(len(words)), r.choice(["you", "thing"]))
        rows.append((i, " ".join(words), f"src{i % 3}"))
        labels.append((i, None, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(spark, tmp_path):
    docs, labels, _ = labelled(spark, 1200)
    got = T.op12_toxicity(spark, save(docs, tmp_path, labels=labels)).collect()
    assert len(got) == 1200
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            right.append(r.predicted == int(r.doc_id % 4 == 0))
    assert np.mean(right) > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = labelled(spark, 300)
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int"))
    mixed = labels.filter(~T.held_out()).union(flipped.filter(T.held_out()))
    (a, x), (b, y) = (T.train(spark, docs, m) for m in (labels, mixed))
    assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_features_by_hand():
    def cut(h, base):
        return (int(h) >> (64 - T.BITS)) + base

    text = "Bad dog, BAD cat"
    ws = [b"bad", b"dog", b"bad", b"cat"]
    h = [np.array([T.xxhash.xxh3_64_intdigest(w)], np.uint64) for w in ws]
    want = {cut(x[0], 0) for x in h}
    for k in (1, 2, 3):
        for x, y in zip(h, h[k:]):
            want.add(cut(T.mix(x * T._ODD[k] + y * T._ODD[8 + k])[0], 1 << T.BITS))
    assert T.text_features(text).tolist() == sorted(want)
    assert T.text_features(None).tolist() == T.text_features(" .,;").tolist() == []


def by_hand(examples):
    """FTRL-proximal one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == T.INTERCEPT else T.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * l1 - z[i]) / ((T.BETA + n[i] ** 0.5) / T.ALPHA + T.L2)

    for x, label in examples:
        at = [*x, T.INTERCEPT]
        value = [T.PAIR if T.SIZE // 2 <= i < T.SIZE else 1.0 for i in at]
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
        for i, wi, v in zip(at, w, value):
            g = (p - label) * v
            step = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / T.ALPHA
            z[i] = z.get(i, 0) + g - step * wi
            n[i] = n.get(i, 0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_learning_equals_the_formulas(monkeypatch):
    monkeypatch.setattr(T, "L1", 0.4)
    r = random.Random(3)
    examples = []
    for i in range(200):
        x = sorted({r.randrange(12) for _ in range(5)} | {T.SIZE // 2 + r.randrange(9) for _ in range(6)})
        examples.append((np.array(x, np.int32), int(3 in x or r.random() < 0.1)))
    model = T.Ftrl()
    for x, label in examples:
        model.learn(x, label)
    at, w = model.model()
    want = by_hand([(x.tolist(), label) for x, label in examples])
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)
    assert 0 < len(at) < 22


def test_weights_are_sparse(spark):
    docs, labels, _ = labelled(spark, 800)
    at, w = T.train(spark, docs, labels)
    assert len(at) < 500 and (w != 0).all() and T.INTERCEPT in at


def test_training_rows_are_bounded(spark):
    docs, labels, _ = labelled(spark, 600)
    assert T.training_rows(docs, labels, 100).count() < 160


def test_order_of_rows_does_not_matter(spark):
    docs, labels, _ = labelled(spark, 200)
    (a, x), (b, y) = (T.train(spark, d, labels) for d in (docs, docs.orderBy("text").repartition(5)))
    assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_odd_rows(spark):
    docs, labels, _ = labelled(spark, 200)
    model = T.train(spark, docs, labels)
    odd = frame(spark, [(None, None), (1, ""), (1, ""), (2, "é " * 100_000), (3, " \n.")])
    scores = {r.score for r in T.classify(spark, odd, model).collect() if r.doc_id != 2}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert T.classify(spark, odd, model).count() == 5
    assert T.classify(spark, spark.createDataFrame([], COLUMNS), model).count() == 0
    none = T.train(spark, docs, labels.limit(0))
    assert {r.score for r in T.classify(spark, docs, none).collect()} == {0.5}
    assert T.train(spark, spark.createDataFrame([], COLUMNS), labels)[0].tolist() == []
    strange = spark.createDataFrame([(1, 1, None), (2, 0, 7), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.training_rows(docs, strange).count() == 0
