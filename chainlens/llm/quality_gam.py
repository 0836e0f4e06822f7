"""Quality classifier: additive model with pairwise interactions (operator 10).

Each whole text becomes ``FEATURES`` numbers (byte histogram, words, lines).  A feature is cut at
quantiles into bins; the model is one table of additive log-odds per feature and one per chosen
pair of features.  The tables are learned by cyclic boosting: round after round, each feature in
turn fits a shallow tree (two or three leaves over its bins) to the log-loss gradient and adds a
small step of it to its table.  Pairs are then ranked by the gain of the best four-quadrant
split of what the single features leave, and the best ``PAIRS`` are boosted in the same way.
Scoring is one bin lookup per table and a sum, vectorised over a batch.

Training rows: labelled, not held out, at most about ``TRAIN_ROWS``, drawn by a hash of the id.
One task fits the model on that bounded table; all documents are scored.  Labels, lang, source
and doc_id are never inputs.

Defined cases: null and empty texts have all features 0 and get the score of that.  Without
training rows of both labels the tables are empty and every score is 0.5 or the share of label
1.  A null ``doc_id`` is not held out.  An id with both labels counts as 0; labels other than 0
and 1 are ignored.  Repeated rows score alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import keep, table

TRAIN_ROWS = 30_000
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 4
BINS = 32
PAIR_BINS = 8
STEP = 0.15
RIDGE = 1.0

FEATURES = ["words", "word_bytes", "distinct", "symbols", "upper", "digits", "marks", "stops", "quotes",
            "lines", "distinct_lines", "line_words", "spaces", "high"]

#: Fixed byte classes.
_CLASSES = {"symbols": b"#*$%&|<>~^_=+@\\/{}[]", "upper": bytes(range(65, 91)), "digits": b"0123456789",
            "marks": b"!?", "stops": b".,;:", "quotes": b"'\"()-", "spaces": b" \t\n\r\x0b\x0c"}


def _class_table() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256))
    for i, chars in enumerate(_CLASSES.values()):
        out[i, list(chars)] = 1
    return out


def text_features(text: str | None, classes: np.ndarray) -> list[float]:
    """The features of one text; shares are per word or per byte, so lengths compare."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    ws = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    c = dict(zip(_CLASSES, (classes @ histogram).tolist()))
    n, size = max(len(ws), 1), max(len(raw), 1)
    return [float(np.log1p(len(ws))), (len(raw) - c["spaces"]) / n, len(set(ws)) / n, c["symbols"] / n, c["upper"] / size,
            c["digits"] / size, c["marks"] / n, c["stops"] / n, c["quotes"] / n, float(np.log1p(len(lines))),
            len(set(lines)) / max(len(lines), 1), float(np.log1p(len(ws) / max(len(lines), 1))), c["spaces"] / size,
            histogram[128:].sum() / size]


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def stump(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins, as one value per bin."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            lg, lh, tg, th = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
            gains = _gain(lg, lh) + _gain(tg - lg, th - lh) - _gain(tg, th)
            i = int(gains.argmax())
            if gains[i] > best[0]:
                best = (gains[i], int(at[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a 2-d table into four quadrants: its gain and one value per cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    r, rh = cg[:-1, -1:], ch[:-1, -1:]
    s, sh = cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a, b), (r - a, rh - b), (s - a, sh - b), (tg - r - s + a, th - rh - sh + b)]
    gains = sum(_gain(x, y) for x, y in parts) - _gain(tg, th)
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(g)
    for (x, y), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = _leaf(x[i, j], y[i, j])
    return float(gains[i, j]), out


class Model:
    """Cut points, one table per feature, and tables of pairs (over coarser bins)."""

    def __init__(self, cuts, coarse, intercept=0.0, tables=None, pairs=None):
        self.cuts, self.coarse, self.intercept = cuts, coarse, intercept
        self.tables = tables if tables is not None else [np.zeros(len(c) + 1) for c in cuts]
        self.pairs = pairs or {}

    def bins(self, x: np.ndarray, cuts) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for b, t in zip(self.bins(x, self.cuts), self.tables):
            total += t[b]
        wide = self.bins(x, self.coarse) if self.pairs else []
        for (i, j), t in self.pairs.items():
            total += t[wide[i], wide[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the best pairs."""
    def points(k):
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0)
                for f in range(x.shape[1])]

    model = Model(points(BINS), points(PAIR_BINS))
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    bins, wide = model.bins(x, model.cuts), model.bins(x, model.coarse)
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            k = len(model.tables[f])
            add = STEP * stump(np.bincount(b, g, k), np.bincount(b, h, k))
            model.tables[f] += add
            total += add[b]

    def grid(i, j, v):
        rows, cols = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(wide[i] * cols + wide[j], v, rows * cols).reshape(rows, cols)

    g, h = slopes()
    ranked = sorted(((quadrants(grid(i, j, g), grid(i, j, h))[0], i, j)
                     for i in range(x.shape[1]) for j in range(i)), reverse=True)
    for _, i, j in ranked[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            add = STEP * quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += add
            total += add[wide[i], wide[j]]
    return model


def _pack(model: Model) -> dict:
    return {"cuts": [c.tolist() for c in model.cuts], "coarse": [c.tolist() for c in model.coarse],
            "intercept": model.intercept, "tables": [t.tolist() for t in model.tables],
            "pairs": [[i, j, t.tolist()] for (i, j), t in model.pairs.items()]}


def _unpack(d: dict) -> Model:
    return Model([np.array(c) for c in d["cuts"]], [np.array(c) for c in d["coarse"]], d["intercept"],
                 [np.array(t) for t in d["tables"]], {(i, j): np.array(t) for i, j, t in d["pairs"]})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the model in one task on at most about ``rows`` labelled documents."""
    import json

    one = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
           .groupBy("doc_id").agg(F.min("quality").alias("label")))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.greatest(one.select(F.count("*")).scalar(), F.lit(1)))
    chosen = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # bounded by ``rows``: a broadcast keeps the texts where they are
    part = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")

    def measure(batches):
        classes = _class_table()
        for b in batches:
            x = [text_features(t.as_py(), classes) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    sample = keep(spark, part.mapInArrow(measure, "x array<double>, label int"), "gam-train")

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=[tuple(v) for v in pdf["x"]]).sort_values(["k", "label"])   # the same sums in any order
        model = fit(np.array(pdf["k"].tolist()).reshape(len(pdf), len(FEATURES)), pdf["label"].to_numpy(float))
        return pd.DataFrame({"model": [json.dumps(_pack(model))]})

    got = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(fit_all, "model string").collect()
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return _unpack(json.loads(got[0].model))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    packed = _pack(model)

    def score(batches):
        classes, model = _class_table(), _unpack(packed)
        for b in batches:
            x = np.array([text_features(t.as_py(), classes) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality_gam": op10_quality_gam}
ORACLE: dict[str, str] = {}
