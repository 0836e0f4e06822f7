import zlib

import numpy as np

from chainlens.llm import quality_gam as G
from tests.llm.common import COLUMNS, frame, save
from tests.llm.test_quality_rules import labelled


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = labelled(spark, 600)
    folder = save(docs, tmp_path, labels=labels)
    got = G.op10_quality_gam(spark, folder).collect()
    assert len(got) == 600
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            right.append(r.predicted == int(r.doc_id % 8 > 1))
    assert np.mean(right) > 0.97


def test_held_out_labels_are_not_used(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", (1 - labels.quality).cast("int"))
    mixed = labels.filter(~G.held_out()).union(flipped.filter(G.held_out()))
    a, b = (G.classify(docs, G.train(spark, docs, x)).orderBy("doc_id").collect() for x in (labels, mixed))
    assert a == b


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(5)
    x = np.zeros((4000, len(G.FEATURES)))
    x[:, :2] = rng.uniform(0, 1, (4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.9


def test_tables_are_additive():
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (500, len(G.FEATURES)))
    model = G.fit(x, (x[:, 2] > 0.4).astype(float))
    one = x[7]
    total = model.intercept + sum(t[np.searchsorted(c, v, side="right")] for v, c, t in zip(one, model.cuts, model.tables))
    total += sum(t[np.searchsorted(model.coarse[i], one[i], side="right"), np.searchsorted(model.coarse[j], one[j], side="right")]
                 for (i, j), t in model.pairs.items())
    assert np.isclose(model.score(x)[7], 1 / (1 + np.exp(-total)))


def test_odd_rows(spark):
    docs, labels = labelled(spark, 80)
    model = G.train(spark, docs, labels)
    odd = frame(spark, [(None, None), (1, ""), (1, ""), (2, "é" * 100_000)])
    scores = [r.score for r in G.classify(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert G.classify(spark.createDataFrame([], COLUMNS), model).count() == 0
    none = G.train(spark, docs, labels.limit(0))
    assert {round(r.score, 6) for r in G.classify(docs, none).collect()} == {0.5}
