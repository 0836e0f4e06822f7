import os

import numpy as np
import pytest

from chainlens.llm import balanced_mix
from tests.llm.common import COLUMNS, frame, prose, words

SF = "/root/testdata/sf0.1"


def brute_targets(sizes):
    """Weights 5, 2, 1 by code point, null last; capped at three times, excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(3 * sizes[s] for s in full)) / max(sum(weight[s] for s in rest), 1)
        target = {s: 3.0 * sizes[s] if s in full else share * weight[s] for s in names}
        over = {s for s in rest if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def make(sources):
    rows, d = [], 0
    for k, (s, n) in enumerate(sources):
        for i in range(n):
            rows.append((d, prose(5 + (i * 37 + k) % 90, d), s))
            d += 1
    return rows


@pytest.mark.parametrize("sources", [
    [("b", 60), ("a", 200), (None, 50), ("é", 40), ("B", 30)],
    [("a", 4), ("b", 300), ("c", 2), ("d", 1)],
    [("only", 80)]])
def test_targets_and_taken(spark, sources):
    rows = make(sources) + [(9001, None, sources[0][0]), (9002, " ", sources[0][0])]
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    docs = frame(spark, rows)
    mixed, times = balanced_mix.mix(spark, docs)
    got = mixed.join(times, "row").collect()
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.times <= 3 and r["size"] == len(words({d: t for d, t, _ in rows}[r.doc_id]))
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.times
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_reruns_agree_and_stage_repeats(spark):
    docs = frame(spark, make([("a", 60), ("b", 90), (None, 20)]))
    once = sorted((r.doc_id, r.times) for r in (lambda x: x[0].join(x[1], "row"))(balanced_mix.mix(spark, docs)).collect())
    again = balanced_mix.mix(spark, docs.repartition(7))
    assert once == sorted((r.doc_id, r.times) for r in again[0].join(again[1], "row").collect())
    out = balanced_mix.stage(spark, docs, "")
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {d: n for d, n in once if n}


def test_many_runs_keep_the_balance(spark, monkeypatch):
    monkeypatch.setattr(balanced_mix, "RUN", 16)
    rows = make([("a", 500), ("b", 300)])
    mixed, times = balanced_mix.mix(spark, frame(spark, rows))
    got = mixed.join(times, "row").groupBy("source", "target").agg({"size": "max"}).collect()
    taken = {r.source: r.t for r in mixed.join(times, "row").selectExpr("source", "size * times AS t").groupBy("source").sum("t")
             .withColumnRenamed("sum(t)", "t").collect()}
    for r in got:
        assert abs(taken[r.source] - r.target) <= r["max(size)"]


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, a = rng.uniform(0.05, 0.95, 200).tolist(), rng.integers(1, 500, 200).astype(float).tolist()
    q = balanced_mix.flight(p, a, np.random.default_rng(2))
    assert sum(1 for v in q if 0 < v < 1) <= 2
    assert sum(q) == pytest.approx(sum(p)) and np.dot(q, a) == pytest.approx(np.dot(p, a))
    mean = np.mean([balanced_mix.flight(p[:20], a[:20], np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - p[:20]).max() < 0.05


def test_large_documents_are_not_left_to_land():
    rng = np.random.default_rng(5)
    for seed in range(20):
        a = np.floor(np.exp(rng.normal(4.5, 1.3, 600))).clip(1, 20_000)
        p = np.full(600, rng.uniform(0.05, 0.95))
        q = balanced_mix.land(balanced_mix.flight(p.tolist(), a.tolist(), np.random.default_rng(seed)), a.tolist())
        assert set(q) <= {0.0, 1.0}
        assert abs(np.dot(q, a) - np.dot(p, a)) <= 0.002 * np.dot(p, a) and abs(sum(q) - sum(p)) <= 2


@pytest.mark.parametrize("a", [[7.0] * 50, [0.0] * 30, [900.0] + [5.0] * 40, [900.0] + [5.0] * 40 + [6.0], [3.0, 1.0], [4.0]])
def test_flight_of_like_sizes(a):
    p = [0.4] * len(a)
    q = balanced_mix.flight(p, a, np.random.default_rng(3))
    assert sum(1 for v in q if 0 < v < 1) <= 2
    assert sum(q) == pytest.approx(sum(p)) and np.dot(q, a) == pytest.approx(np.dot(p, a))


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_taken_words_come_near_every_target(spark):
    rows, times = balanced_mix.mix(spark, spark.read.parquet(f"{SF}/documents.parquet"), carry=False)
    got = rows.join(times, "row").selectExpr("source", "target", "size * times AS words").groupBy("source", "target").sum("words")
    assert all(abs(r["sum(words)"] - r.target) <= 0.005 * r.target for r in got.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    rows, times = balanced_mix.mix(spark, docs)
    assert rows.count() == 0 and times.count() == 0 and balanced_mix.stage(spark, docs, "").count() == 0


def test_repeated_and_null_ids_are_dealt_to_many_runs(spark, monkeypatch):
    monkeypatch.setattr(balanced_mix, "RUN", 16)
    seen, decide = spark.sparkContext.accumulator(0), balanced_mix._decide

    def counted(level):
        run = decide(level)

        def limited(key, pdf):
            assert level or len(pdf) <= 4 * 16, len(pdf)
            seen.add(1)
            return run(key, pdf)
        return limited
    monkeypatch.setattr(balanced_mix, "_decide", counted)
    rows = make([("a", 500), ("b", 300)])
    hot = [(None if i % 2 else 7, "the same words" if i % 3 else t, s) for i, (_, t, s) in enumerate(rows)]
    mixed, times = balanced_mix.mix(spark, frame(spark, hot))
    assert mixed.join(times, "row").count() == len(rows) and seen.value > 20
