"""Quality rules: a learned decision list (operator 5, native).

:func:`measure` computes the base counts and shape features of every whole text with built-in
functions.  :func:`learn` grows an ordered list of rejection rules by sequential covering over
labelled rows: a rule is a conjunction of threshold tests; each step adds the test with the
largest FOIL gain, read from one grouped count of (feature, bin, label); a finished rule is
pruned on rows that did not grow it, kept if it is precise there, and the rows it covers leave
the training set.  :func:`verdict` turns the list into one ``CASE`` expression.  Only DataFrame
and SQL functions touch rows; the driver sees counts per feature and bin.

Words of repeated 3-word windows are found by 64-bit window hashes within one text.

Training uses at most about ``TRAIN_ROWS`` labelled rows, drawn by a hash of the id; every row
is scored.  Labels that are neither 0 nor 1 are ignored; an id with both labels counts as 0.

Defined cases: null and empty texts have no words, fail the base rules and are not kept.
Without labels, or with labels of one class only, the list is empty and the base rules decide
alone.  Repeated rows are judged alike; an empty table gives no rows; extra columns are
ignored, or kept as they are by :func:`stage`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import keep, table

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
TRAIN_ROWS = 20_000
MAX_RULES = 8
MAX_TESTS = 3
MIN_PRECISION = 0.95
MIN_COVER = 5
QUANTILES = [i / 20 for i in range(1, 20)] + [0.005, 0.01, 0.02, 0.97, 0.98, 0.99, 0.995]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shape features, all per 1000: comparable between short and long texts.
FEATURES = ["symbols", "word_length", "repeats", "dup_lines", "upper", "marks", "digits"]


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``m`` of the base counts and features of ``text``."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    d = d.select("doc", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
                 F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    n = F.size("w")
    hashed = F.when(n >= 3, F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(
        x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("*", hashed.alias("h"))
    # sorted (window, place): neighbours with one hash are found twice or more
    order = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select("doc", "w", "lines", order.alias("o"))

    def again(x, j):
        before = F.get("o", j - 1).getField("h")
        after = F.get("o", j + 1).getField("h")
        return ((j > 0) & (before == x.h)) | F.coalesce(after == x.h, F.lit(False))

    d = d.select("doc", "w", "lines", F.array_sort(
        F.transform(F.filter("o", again), lambda x: x.i)).alias("at"))
    # each repeated window covers three words, less what the next one covers as well
    covered = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))))
    total = F.lit(0).cast("long")
    d = d.select(
        "doc", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", total, lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, total, lambda a, x: a + x).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-Z]")).alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!?=_~^@\\{}\[\]]")).alias("n_marks"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("n_digits"))

    def per(a: str, b: str) -> Column:
        return (F.lit(1000.0) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")

    return d.select("doc", F.struct(
        *BASE, per("n_symbols", "n_words").alias("symbols"), per("word_chars", "n_words").alias("word_length"),
        per("n_repeat_words", "n_words").alias("repeats"), per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("n_upper", "word_chars").alias("upper"), per("n_marks", "n_words").alias("marks"),
        per("n_digits", "word_chars").alias("digits")).alias("m"))


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(bad, prune, and the features) of at most about ``rows`` labelled documents, written."""
    one = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.greatest(one.select(F.count("*")).scalar(), F.lit(1)))
    chosen = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # bounded by ``rows``: a broadcast keeps the texts where they are
    part = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return keep(spark, measure(part).select(
        F.col("doc.bad").alias("bad"), (F.pmod(F.xxhash64("doc.doc_id", F.lit(11)), F.lit(3)) == 0).alias("prune"),
        *[F.col(f"m.{f}").alias(f) for f in FEATURES]), "rules-train")


def _thresholds(train: DataFrame) -> dict[str, list[float]]:
    """Cut points half way between neighbouring quantiles."""
    row = train.agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in FEATURES],
                    *[F.min(f).alias(f"lo_{f}") for f in FEATURES], *[F.max(f).alias(f"hi_{f}") for f in FEATURES]).first()
    cuts = {}
    for f in FEATURES:
        values = sorted({row[f"lo_{f}"], row[f"hi_{f}"], *(row[f] or [])} - {None})
        cuts[f] = [round((a + b) / 2, 6) for a, b in zip(values, values[1:])]
    return cuts


def _test(test: tuple[str, bool, float], prefix: str = "") -> Column:
    feature, above, cut = test
    value = F.col(prefix + feature)
    return value >= cut if above else value < cut


def _all(tests: list[tuple[str, bool, float]], prefix: str = "") -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & _test(t, prefix)
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, good) rows by feature and bin, one grouped count."""
    def place(f: str) -> Column:
        below = F.filter(F.array(*map(F.lit, cuts[f])), lambda cut: cut <= F.col(f))
        return F.struct(F.lit(f).alias("f"), F.size(below).alias("b"))

    bins = [place(f) for f in FEATURES if cuts[f]]
    if not bins:
        return {}
    got = (rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b")
           .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect())
    return {(r.f, r.b): (r.p, r.n) for r in got}


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[str, bool, float]]:
    tests: list[tuple[str, bool, float]] = []
    while len(tests) < MAX_TESTS:
        counts = _counts(rows.filter(_all(tests)), cuts)
        feature = next((f for f, _ in counts), None)
        if feature is None:
            break
        p0 = sum(p for (f, _), (p, _) in counts.items() if f == feature)
        n0 = sum(n for (f, _), (_, n) in counts.items() if f == feature)
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, cs in cuts.items():
            for k, cut in enumerate(cs):
                for above in (True, False):
                    hit = [v for (g, b), v in counts.items() if g == f and (b > k) == above]
                    p, n = sum(v[0] for v in hit), sum(v[1] for v in hit)
                    if p >= MIN_COVER:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        best = max(best, (gain, (f, above, cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        tests.append(best[1])
    return tests


def _prune(rows: DataFrame, tests: list[tuple[str, bool, float]]) -> tuple[list[tuple[str, bool, float]], int, int]:
    """The shortest front of ``tests`` that is as precise on ``rows`` as any, with its counts."""
    fronts = [tests[:k] for k in range(1, len(tests) + 1)]
    sums = rows.agg(*[F.count_if(_all(t) & F.col("bad")).alias(f"p{i}") for i, t in enumerate(fronts)],
                    *[F.count_if(_all(t) & ~F.col("bad")).alias(f"n{i}") for i, t in enumerate(fronts)]).first()
    worth = [((sums[f"p{i}"] + 1) / (sums[f"p{i}"] + sums[f"n{i}"] + 2), -i) for i in range(len(fronts))]
    i = -max(worth)[1]
    return fronts[i], sums[f"p{i}"], sums[f"n{i}"]


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[list[tuple[str, bool, float]]]:
    """Ordered rejection rules, each a list of (feature, at least?, threshold)."""
    left = training_rows(spark, docs, labels)
    cuts, rules = _thresholds(left), []
    while len(rules) < MAX_RULES:
        tests = _grow(left.filter("NOT prune"), cuts)
        if not tests:
            break
        tests, p, n = _prune(left.filter("prune"), tests)
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(tests)
        left = left.filter(~_all(tests))
    return rules


def verdict(rules: list[list[tuple[str, bool, float]]], prefix: str = "m.") -> Column:
    """True where no rule rejects; the rules are tried in order."""
    out = None
    for tests in rules:
        out = F.when(_all(tests, prefix), F.lit(False)) if out is None else out.when(_all(tests, prefix), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, m, base_failed, kept) for every row of ``docs``."""
    rules = learn(spark, docs, labels)
    return measure(docs).select("doc", "m", base_failed().alias("base_failed"),
                                F.when(base_failed(), F.lit(False)).otherwise(verdict(rules)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the base rules and the decision list keep."""
    judged = judge(spark, docs, table(spark, sf_dir, "labels"))
    # beside a column that is not deterministic the filter stays above the measures; pushed below
    # them it would hold each measure's whole expression once per use
    numbered = judged.select("doc", "kept", F.monotonically_increasing_id().alias("at"))
    return numbered.filter("kept AND at >= 0").select("doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(spark, docs, table(spark, sf_dir, "labels")).select(
        "doc.doc_id", *[f"m.{c}" for c in BASE], "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict[str, str] = {}
