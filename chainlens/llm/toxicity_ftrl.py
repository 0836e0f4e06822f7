"""Toxicity by FTRL-proximal logistic regression (operator 12).

A text's features are the hashes of its words, of pairs of neighbours and of skip-grams (pairs with
one or two words between them), each present or not; words and pairs have a half of the coordinates
each, and a pair counts ``PAIR`` of a word.  The model is one weight per hashed coordinate.  FTRL-proximal learns them document by document: every coordinate has a learning rate
of its own, which falls with the gradients that it has seen, and an L1 penalty keeps a weight at
zero until its evidence exceeds it.  So most of the ``SIZE`` coordinates stay zero, and the others
(a few thousand; never more than ``SIZE``) are what tasks get to score with.

Training rows: labelled, not held out, at most about ``TRAIN_ROWS``, drawn by a hash of the id.  One
task learns from their features, streamed in a fixed order ``EPOCHS`` times, so it holds the
coordinates and one batch; all documents are scored.  Labels, lang, source and doc_id are never
inputs.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered.

Defined cases: null and empty texts have no features and score the intercept.  Without training
rows every score is 0.5; with one label alone the scores go to that side.  A null ``doc_id`` is not
held out and does not train.  An id with both labels counts as 1; labels other than 0 and 1 are
ignored.  Rows that repeat an id train and score each by their own text.  An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.licenses import tokens
from chainlens.llm.scratch import keep, table
from chainlens.llm.shingles import _ODD, mix

TRAIN_ROWS = 20_000
EPOCHS = 2
BITS = 20
SIZE = 2 << BITS          # words, then pairs
INTERCEPT = SIZE          # its own coordinate, without penalty
SKIPS = (1, 2, 3)         # distance of the two words of a pair
PAIR = 0.2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
THRESHOLD = 0.3


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text's words, pairs and skip-grams."""
    ws = tokens(text)
    if not ws:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    pairs = [mix(h[:-k] * _ODD[k] + h[k:] * _ODD[8 + k]) for k in SKIPS if len(h) > k]
    cut = np.uint64(64 - BITS)
    return np.unique(np.concatenate([h >> cut, *((p >> cut) + np.uint64(1 << BITS) for p in pairs)]).astype(np.int32))


def values(at: np.ndarray) -> np.ndarray:
    """What a feature counts, by its coordinate."""
    return np.where((at >> BITS) == 1, PAIR, 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal: sums of gradients ``z`` and of their squares ``n``."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == INTERCEPT, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, x: np.ndarray, label: int) -> None:
        at = np.append(x, INTERCEPT)
        w, v = self.weights(at), values(at)
        g = (_sigmoid(w @ v) - label) * v
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates whose weight is not zero, and their weights."""
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return at[w != 0].astype(np.int32), w[w != 0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(place, label, x): features of at most about ``rows`` labelled documents; ``place`` orders them."""
    one = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.greatest(one.select(F.count("*")).scalar(), F.lit(1)))
    chosen = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)

    def measure(batches):
        for b in batches:
            x = [text_features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.int32()))], ["place", "label", "x"])

    # bounded by ``rows``: a broadcast keeps the texts where they are
    part = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return part.select(F.xxhash64("doc_id", "text").alias("place"), "label", "text").mapInArrow(
        measure, "place long, label int, x array<int>")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights, learned in one task from the bounded training rows."""
    sample = keep(spark, training_rows(docs, labels, rows), "ftrl-train")

    def learn(batches):
        model = Ftrl()
        for b in batches:
            x = b.column(1)
            at, ends = x.values.to_numpy(), x.offsets.to_numpy()
            for label, start, end in zip(b.column(0).to_pylist(), ends, ends[1:]):
                model.learn(at[start:end], label)
        at, w = model.model()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.float64())], ["at", "w"])

    # each epoch in another order; rows that tie are the same
    turns = sample.select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "place", "label", "x")
    ordered = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("place", "epoch"), "place").select("label", "x")
    got = ordered.mapInArrow(learn, "at int, w double").toArrow()     # what L1 leaves of SIZE coordinates
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def classify(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        at, w = shared.value
        weight = np.zeros(SIZE + 1, np.float32)
        weight[at] = w * values(at)
        for b in batches:
            total = [weight[text_features(t.as_py())].sum(dtype=float) + weight[INTERCEPT] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(np.array(total, float)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    return classify(spark, docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                               (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE: dict[str, str] = {}
