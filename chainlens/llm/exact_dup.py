"""Exact duplicates by distributed MSD radix partitioning (operator 4).

A document is read as its length followed by its bytes.  The first digit is the length with
the first ``FIRST_DIGIT`` bytes; each further digit is the next run of bytes, eight times
longer, up to ``MAX_DIGIT``.  A group is the set of documents that agree on all digits so
far.  Each round counts (group, digit) with map-side partial counts, drops singletons and
joins the survivors to their new group; since lengths are equal within a group, its documents
end together, and what has ended in a group of two or more is equal byte by byte.  No digest
takes part in equality (``text_sha256`` is an output column only).

One shuffle moves whole texts, in the first round; later rounds move survivors.  Every join
has one small row per group on its right side, so a hot group is split by adaptive skew
handling.  Row numbers and group numbers are taken when a table is written, so they hold for
all later plans.

Defined cases: a null text counts as empty.  Null ids sort below all others.  Of rows that
tie in the largest ``doc_id`` of equal texts exactly one stays.  An empty table gives no
rows; extra columns are ignored, or kept as they are by :func:`stage`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import anything, discard, keep, table

FIRST_DIGIT = 64
GROWTH = 8
MAX_DIGIT = 1 << 20


def _split(spark: SparkSession, live: DataFrame) -> DataFrame:
    """(grp, digit, name) of the groups of two rows or more; ``name`` is the new group."""
    counts = live.groupBy("grp", "digit").agg(F.count("*").alias("m")).filter("m > 1")
    return keep(spark, counts.select("grp", "digit", F.monotonically_increasing_id().alias("name")), "digits")


def radix(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (row, doc, grp), and (row, grp) of those with an equal text.

    ``doc`` is the whole row as a struct; in the first table ``grp`` is null where the first
    digit already sets a row apart, in the second it names the class of equal texts.
    """
    raw = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    first = docs.select("doc", F.length(raw).cast("long").alias("grp"), F.substring(raw, 1, FIRST_DIGIT).alias("digit"))
    split = _split(spark, first.select("grp", "digit"))
    # the groups grow with the input, so they are merged and not broadcast at any size
    rows = keep(spark, first.join(split.hint("merge"), ["grp", "digit"], "left")
                .select(F.monotonically_increasing_id().alias("row"), "doc", F.col("name").alias("grp")), "rows")
    discard(spark, split)

    at, width = FIRST_DIGIT, FIRST_DIGIT * GROWTH
    live = rows.filter("grp IS NOT NULL").select("row", "grp", raw.alias("bytes"))
    ended = live.filter(F.length("bytes") <= at).select("row", F.lit(at).alias("round"), "grp")
    live = live.filter(F.length("bytes") > at)
    while anything(live):
        digit = live.withColumn("digit", F.expr(f"substring(bytes, {at + 1}, {width})"))
        split = _split(spark, digit.select("grp", "digit"))
        at += width
        width = min(width * GROWTH, MAX_DIGIT)
        over = F.length("bytes") <= at
        step = keep(spark, digit.join(split.hint("merge"), ["grp", "digit"])
                    .select("row", F.col("name").alias("grp"), over.alias("over"), F.when(~over, F.col("bytes")).alias("bytes")),
                    "live")
        discard(spark, split)
        # group numbers of different rounds may meet: the round keeps them apart
        ended = ended.union(step.filter("over").select("row", F.lit(at).alias("round"), "grp"))
        live = step.filter("NOT over").select("row", "grp", "bytes")
    return rows, ended


def _verdict(spark: SparkSession, rows: DataFrame, ended: DataFrame) -> DataFrame:
    """(row, keep_id, group_size, keep_row) of the rows whose text another row has as well."""
    named = keep(spark, ended.join(rows.filter("grp IS NOT NULL").select("row", F.col("doc.doc_id").alias("doc_id")), "row"),
                 "equal")
    best = keep(spark, named.groupBy("round", "grp").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
                "best")
    first = (named.join(best, ["round", "grp"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .groupBy("round", "grp").agg(F.min("row").alias("keep_row")))
    best = keep(spark, best.join(first, ["round", "grp"]), "keepers")
    return named.select("row", "round", "grp").join(best, ["round", "grp"]).drop("round", "grp")


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, ended = radix(spark, docs.select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"), 256)
    alone = F.col("keep_row").isNull()
    return (rows.select("row", F.col("doc.doc_id").alias("doc_id"), digest.alias("text_sha256"))
            .join(_verdict(spark, rows, ended), "row", "left")
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the document with the largest id, columns unchanged."""
    rows, ended = radix(spark, docs)
    drop = _verdict(spark, rows, ended).filter("row != keep_row").select("row")
    alone, grouped = rows.filter("grp IS NULL"), rows.filter("grp IS NOT NULL")
    return alone.select("doc.*").union(grouped.join(drop, "row", "left_anti").select("doc.*"))


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_duplicates": op4_exact_duplicates}
ORACLE = {"op4_exact_duplicates": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""}
