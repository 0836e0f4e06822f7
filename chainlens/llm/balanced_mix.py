"""Mixing sources to target weights by the cube method (operator 2).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating.  The total size is
shared by weight; a target stops at ``MAX_REPEAT`` times its source's size and the excess is
shared again.  That is the level L with sum(min(L * weight, 3 * size)) = total, found from
running sums over one row per source.

A source with ratio r = target / size takes each document floor(r) times, and once more with
inclusion probability frac(r).  The cube method fixes who is included: the vector of
probabilities moves at random through the null space of the balancing constraints (words and
documents) until a component reaches 0 or 1, so the word and document totals stay what they
were.  Two constraints leave at most two documents of a run undecided.  Runs hold
``RUN`` documents of one source, dealt by a hash of id and text (rows that repeat both: and of
their number); what they leave undecided is
balanced in runs of the next level, until one run per source is left: its two documents
are the landing problem, solved by trying all choices.  A hot source is many runs; no task sees
more than ``RUN`` rows of one group, and only ids and sizes are moved.

Within a run the largest open document is decided against all others together, which move a
little each, so that small ones are left to land.  All random moves are seeded by source, run
and level, so reruns agree.

Defined cases: null and empty texts have size 0 and take 0 words (their repeats still follow
the source's ratio).  A source without words has target 0.  Null sources are one source.
Rows that repeat an id are decided each on their own.  Extra columns are ignored, or kept by
:func:`stage`, which repeats a row as often as the mix takes it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.scratch import anything, keep, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
RUN = 2048
EDGE = 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target), one row per source of ``sized`` (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # one row per source from here on
    at = (F.row_number().over(order) - 1) % len(WEIGHTS)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (at + 1).cast("int")).cast("double"))
    every = Window.partitionBy(F.lit(1))
    # sources fill up in the order of cap / weight
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    per = (per.withColumn("cap", MAX_REPEAT * F.col("source_size").cast("double"))
           .withColumn("total", F.sum("source_size").over(every).cast("double"))
           .withColumn("all_w", F.sum("w").over(every))
           .withColumn("full", F.coalesce(F.sum("cap").over(filling), F.lit(0.0)))
           .withColumn("full_w", F.coalesce(F.sum("w").over(filling), F.lit(0.0))))
    # the level if all sources before this one are full; the first source that stays below its
    # cap sets it, and later ones, which take it for full, only come out lower
    level = (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("full_w"))
    per = per.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    per = per.withColumn("level", F.max("level").over(every))
    return per.select("source", "source_size", "n_docs",
                      F.least(F.col("level") * F.col("w"), "cap").alias("target"))


def flight(p: list[float], a: list[float], rng: np.random.Generator) -> list[float]:
    """Moves ``p`` through the null space of two constraints until two components are open.

    The constraints are the words (``a``) and the number of documents that are chosen.  Each step
    moves the largest open document; all other open ones move against it, along the projection
    of that document onto the null space, in one of both directions and as far as a component
    allows, with chances that keep every mean.
    """
    p, a = np.array(p, dtype=float), np.asarray(a, dtype=float)
    left = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    left = left[np.argsort(-a[left], kind="stable")]
    draws = iter(rng.random(len(left)).tolist())
    while len(left) > 1:
        mean = a[left[1:]].mean()
        off, spread = a[left[0]] - mean, a[left[1:]] - mean
        varied = spread @ spread
        if varied < 0.1 and off > 0.1:
            left = left[1:]     # all others have one size: no direction moves this one
            continue
        u = np.full(len(left), -1 / len(spread))
        u[0] = 1.0
        if varied >= 0.1:
            u[1:] -= off / varied * spread
        q = p[left]
        with np.errstate(divide="ignore"):
            high, low = (1 - q) / u, -q / u
        up, down = np.maximum(high, low).min(), np.maximum(-high, -low).min()
        q += (up if next(draws) * (up + down) < down else -down) * u
        q[q <= EDGE], q[q >= 1 - EDGE] = 0.0, 1.0
        p[left] = q
        left = left[(q > 0) & (q < 1)]
    return p.tolist()


def land(p: list[float], a: list[float]) -> list[float]:
    """Decides the open components: the choice whose words come nearest to what is due."""
    left = [i for i, v in enumerate(p) if EDGE < v < 1 - EDGE]
    due, due_docs = sum(p[i] * a[i] for i in left), sum(p[i] for i in left)
    best = min(range(1 << len(left)), key=lambda c: (
        abs(sum(a[i] for j, i in enumerate(left) if c >> j & 1) - due), abs(c.bit_count() - due_docs), c))
    p = list(p)
    for j, i in enumerate(left):
        p[i] = float(best >> j & 1)
    return p


def _decide(level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "spot", "row"], ascending=[False, True, True], kind="mergesort")
        p, a = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
        p = flight(p, a, np.random.default_rng([level, int(key[1]), xxhash.xxh64_intdigest(key[0])]))
        if pdf["runs"].iloc[0] == 1:
            p = land(p, a)
        return pdf.assign(p=p)[["row", "src", "size", "spot", "runs", "p"]]
    return run


def mix(spark: SparkSession, docs: DataFrame, carry: bool = True) -> tuple[DataFrame, DataFrame]:
    """The numbered rows (row, doc_id, source, size, doc), and (row, source_size, target, times).

    ``doc`` is the whole row as a struct, only where ``carry`` is set.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source",
                       n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("spot"), *[whole][:carry])
    rows = keep(spark, rows, "mix-rows")
    # rows that repeat id and text would be one run: their numbers deal them
    again = keep(spark, rows.groupBy("spot").agg(F.count("*").alias("m")).filter("m > 1").select("spot", F.lit(True).alias("again")),
                 "mix-again")
    slim = rows.select("row", "source", "size", "spot").join(again, "spot", "left").withColumn(
        "spot", F.when(F.col("again"), F.xxhash64("spot", "row")).otherwise(F.col("spot"))).drop("again")
    rows = rows.drop("spot")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    src = (targets(slim.select("source", "size")).withColumn("base", F.floor(ratio + EDGE).cast("int"))
           .withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
           .withColumn("runs", F.ceil(F.col("n_docs") / RUN))
           .withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    src = keep(spark, src.withColumnRenamed("source", "key"), "mix-sources")
    placed = keep(spark, slim.join(src, F.col("source").eqNullSafe(F.col("key")))
                  .select("row", "src", "size", "spot", "runs", "p", "base", "source_size", "target"), "mix-placed")
    open_ = placed.select("row", "src", "size", "spot", "runs", "p").filter(F.col("p").between(EDGE, 1 - EDGE))
    taken, level = None, 0
    while anything(open_):
        run = F.pmod(F.col("spot"), F.col("runs"))
        done = keep(spark, open_.groupBy("src", run.alias("run")).applyInPandas(
            _decide(level), "row long, src string, size long, spot long, runs long, p double"), "mix-level")
        one = done.filter(F.col("p") >= 1 - EDGE).select("row")
        taken = one if taken is None else taken.union(one)
        open_ = done.filter(F.col("p").between(EDGE, 1 - EDGE)).withColumn("runs", F.ceil(2 * F.col("runs") / RUN))
        level += 1
    whole = placed.filter(F.col("p") > 1 - EDGE).select("row")
    more = (whole if taken is None else taken.union(whole)).select("row", F.lit(1).alias("more"))
    times = placed.join(more, "row", "left").select(
        "row", "source_size", "target", (F.col("base") + F.coalesce("more", F.lit(0))).alias("times"))
    return rows, times


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, columns unchanged."""
    rows, times = mix(spark, docs)
    return (rows.select("row", "doc").join(times.filter("times > 0").select("row", "times"), "row")
            .select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*"))


def op2_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = mix(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=False)
    return rows.select("row", "doc_id", "size").join(times, "row").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


QUERIES = {"op2_balanced_mix": op2_balanced_mix}
ORACLE: dict[str, str] = {}
