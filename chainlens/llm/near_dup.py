"""MinHash near-duplicates by circulant MinHash (operator 7).

1. One scan makes each document's 5-word shingle set and, from two permutations, its
   signature of 128 coordinates (``shingles.Circulant``); only the 32 band keys, the set size
   and a 128-bit fingerprint of the set are written.
2. Documents with equal sets collapse to one node, so a group of a million copies costs one
   counter per map task and one signature.
3. Nodes meet in band buckets.  Only nodes that share a bucket have their full sets built,
   and links are confirmed on those (``links.linked_components``).

At similarity 0.75 a pair misses all 32 bands of 4 rows with probability 6e-6.

Defined cases: null and empty texts and texts of separators have an empty set, are linked
with nothing and form their own component.  Texts of fewer than 5 words have one shingle, the
whole sequence.  A null ``doc_id`` is ignored by the smallest-id rule; a component of null ids
alone has a null ``component_id`` and ``kept`` true.  Rows that repeat a ``doc_id`` are judged
by their own texts.  Extra columns are ignored, or kept as they are by :func:`stage`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.links import linked_components
from chainlens.llm.scratch import discard, keep, table
from chainlens.llm.shingles import Circulant, fingerprint, shingle_set

PERCENT = 75
SIGNED = "row long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def _sign(batches):
    minhash = Circulant()
    for t in batches:
        ids, sizes, f1, f2, bands = [], [], [], [], []
        for i, text in enumerate(t.column("text")):
            grams = shingle_set(text.as_py())
            sizes.append(len(grams))
            a, b = fingerprint(grams) if len(grams) else (None, None)
            f1.append(a)
            f2.append(b)
            bands.append(minhash.band_keys(minhash.signature(grams)) if len(grams) else None)
        yield pa.RecordBatch.from_arrays(
            [t.column("row"), t.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()),
             pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["row", "doc_id", "n_shingles", "f1", "f2", "bands"])


def _sets(batches):
    for t in batches:
        f1, f2, grams = [], [], []
        for text in t.column("text"):
            g = shingle_set(text.as_py())
            a, b = fingerprint(g) if len(g) else (None, None)
            f1.append(a)
            f2.append(b)
            grams.append(g.view("i8"))
        yield pa.RecordBatch.from_arrays(
            [t.column("node"), t.column("w1"), t.column("w2"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
             pa.array(grams, pa.list_(pa.int64()))], ["node", "w1", "w2", "f1", "f2", "grams"])


def _components(spark: SparkSession, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed ``rows`` (row, doc_id, text), and (row, doc_id, comp) of those with a set."""
    texts = rows.select("doc_id", "text")
    signed = keep(spark, rows.select("row", "doc_id", "text").mapInArrow(_sign, SIGNED), "signed")
    some = signed.filter("n_shingles > 0")

    # equal sets: the group's node is its smallest row
    copies = keep(spark, some.groupBy("f1", "f2").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
                  .filter("copies > 1").drop("copies"), "copies")
    named = some.select("row", "doc_id", "n_shingles", "f1", "f2").join(copies, ["f1", "f2"], "left") \
        .withColumn("node", F.coalesce("node", "row"))
    extra = keep(spark, some.select("row", "f1", "f2").join(copies, ["f1", "f2"]).filter("row != node").select("row"), "extra")
    nodes = some.join(extra, "row", "left_anti")

    keys = nodes.select(F.explode("bands").alias("bkey"), F.col("row").alias("node"), F.col("n_shingles").alias("n"))
    shared = keep(spark, keys.groupBy("bkey").agg(F.count("*").alias("m"), F.min("n").alias("least"))
                  .filter("m > 1").select("bkey", "least"), "shared")
    members = keep(spark, keys.join(shared, "bkey"), "members")

    # full sets of the nodes that share a bucket, built again from their texts
    wanted = (members.select("node").distinct()
              .join(nodes.select(F.col("row").alias("node"), "doc_id", F.col("f1").alias("w1"), F.col("f2").alias("w2")),
                    "node"))
    # the wanted grow with the input, so they are merged and not broadcast at any size
    sets = keep(spark, texts.join(wanted.withColumnRenamed("doc_id", "want").hint("merge"), texts.doc_id.eqNullSafe(F.col("want")))
                .select("node", "w1", "w2", "text")
                .mapInArrow(_sets, "node long, w1 long, w2 long, f1 long, f2 long, grams array<long>")
                .filter("f1 = w1 AND f2 = w2").select("node", "grams").dropDuplicates(["node"]), "sets")

    comp = linked_components(spark, members, sets, percent)
    placed = keep(spark, named.select("row", "doc_id", "node").join(comp, "node", "left")
                  .select("row", "doc_id", F.coalesce("comp", "node").alias("comp")), "placed")
    discard(spark, copies, extra, shared, members, sets)
    return signed, placed


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed, placed = _components(spark, docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), percent)
    # most documents are alone: only components of two rows or more need a name
    heads = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    heads = keep(spark, heads.filter("m > 1").drop("m"), "heads")
    grouped = placed.join(heads, "comp").select("row", "component_id", F.lit(True).alias("found"))
    return (signed.select("row", "doc_id", "n_shingles").join(grouped, "row", "left")
            .withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component, columns unchanged.

    That is the row of the smallest id, and of rows that repeat this id the first.  Rows with a null
    ``doc_id`` come last.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = keep(spark, docs.select(F.monotonically_increasing_id().alias("row"), whole), "near-rows")
    signed, placed = _components(spark, rows.select("row", "doc.doc_id", "doc.text"), PERCENT)
    discard(spark, signed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    heads = placed.groupBy("comp").agg(first.alias("first"), F.count("*").alias("m")).filter("m > 1")
    drop = placed.select("row", "comp").join(keep(spark, heads.select("comp", F.col("first.row").alias("keep_row")), "heads"), "comp")
    drop = drop.filter("row != keep_row").select("row").hint("merge")
    return rows.join(drop, "row", "left_anti").select("doc.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLE = {"op7_near_duplicates": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM words),
sizes AS (SELECT doc_id, len(g) AS n FROM grams),
flat AS MATERIALIZED (SELECT doc_id, unnest(g) AS s FROM grams),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT doc_id, doc_id FROM sizes UNION SELECT r.node, l.b FROM r JOIN links l ON l.a = r.seen)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id"""}
