"""Connected components of the links that hold between members of common buckets.

Comparing all pairs of a bucket is quadratic, and comparing with one member alone misses
links.  So buckets are worked off in rounds.  In each round every bucket whose members
still lie in more than one component names one hub, and its members outside the hub's
component are compared with it; verified links merge components.  Buckets that lie within
one component are closed.

Between rounds members are peeled: a link asks that ``percent`` of a set's shingles lie in the
partner's set, so a member of which fewer occur in open members of other components has no link
left to find.  That is one count per shingle, not per pair, and clears buckets that only a
common passage holds together.

When a round finds no new link, or after ``HUB_ROUNDS``, the pairs across components that are
left are found by an exact prefix filter (``_prefix_pairs``) and compared once, each pair once
however many buckets it shares.  The components are then exact for the buckets given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.scratch import anything, discard, in_slice, keep, keep_all, slices
from chainlens.llm.shingles import overlap

HUB_ROUNDS = 2
PAIR_SLICES = 2        # of the sets, for either end of the pairs
PEELS = 2


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node that each node of ``edges`` (a, b) reaches.

    Minimum labels spread over the edges and are shortened by pointer jumping; every step is
    a written table, so a lost executor costs one step at most.
    """
    both = keep(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")), "labels")
    while anything(labels.filter("moved")):
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = keep(spark, step.join(jump, "mid").select(
            "node", F.least("mid", "far").alias("comp"), (F.least("mid", "far") < F.col("old")).alias("moved")), "labels")
        discard(spark, labels)
        labels = new
    discard(spark, both)
    return labels.select("node", "comp")


def similar(spark: SparkSession, pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): whether 100 * intersection >= percent * union on the full sets, ``left`` of a, ``right`` of b."""
    def verify(batches):
        for t in batches:
            left, right = t.column("ga"), t.column("gb")
            ok = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (left[i], right[i]))
                both = overlap(x, y)
                ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(ok)], ["a", "b", "linked"])

    full = (pairs.join(left.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
            .join(right.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b"))
    return full.select("a", "b", "ga", "gb").mapInArrow(verify, "a long, b long, linked boolean")


def _tested(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of ``pairs``, written; with many sets, those pairs at a time whose ends lie in given slices of them."""
    pairs = keep(spark, pairs, "pairs")
    n = slices(sets, PAIR_SLICES)       # the sets are dealt, however few the pairs

    def own(df: DataFrame, node: str, k: int) -> DataFrame:
        return df.filter(in_slice(F.xxhash64(node), k, n))

    def parts():
        for i in range(n):
            for j in range(n):
                full = (own(own(pairs, "a", i), "b", j), own(sets, "node", i), own(sets, "node", j))
                yield similar(spark, *full, percent)

    tested = keep_all(spark, parts(), "tested")
    discard(spark, pairs)
    return tested


def _open(spark: SparkSession, members: DataFrame) -> DataFrame:
    """The members (bkey, node, n, least, c) of buckets that hold more than one component."""
    mixed = members.groupBy("bkey").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bkey")
    return keep(spark, members.join(mixed, "bkey"), "open")


def _crossing(spark: SparkSession, grams: DataFrame) -> DataFrame:
    """(g, df) of the shingles of ``grams`` (c, g) that occur in more than one component; written, so that
    the shuffle that counts them is gone before they are joined."""
    counts = grams.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df"))
    return keep(spark, counts.filter("lo < hi").select("g", "df"), "crossing")


def _counts(spark: SparkSession, nodes: DataFrame, sets: DataFrame, n: int):
    """For each of ``n`` slices of the shingles (node, u, w): how many of the node's shingles occur in more than
    one component of ``nodes`` (node, c), and how often these occur."""
    for k in range(n):
        some = F.filter("grams", lambda g: in_slice(g, k, n)) if n > 1 else F.col("grams")
        grams = keep(spark, sets.select("node", some.alias("grams")).join(nodes, "node")
                     .select("node", "c", F.explode("grams").alias("g")), "grams")
        crossing = _crossing(spark, grams)
        yield grams.join(crossing, "g").groupBy("node").agg(F.count("*").alias("u"), F.sum("df").alias("w"))
        discard(spark, grams, crossing)


def _peel(spark: SparkSession, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` without those that can have no link to an open member of another component,
    and with ``w``, the mean number of open members that hold a shingle of the member.

    A link of x and y asks for percent / (100 + percent) * (|x| + |y|) common shingles, and all
    of them lie in members of other components.  |y| is no less than the smallest set of the
    bucket, nor than ``percent`` of |x|.
    """
    for _ in range(PEELS):
        # one row per node: what it is asked is asked once, whatever the number of its buckets
        nodes = keep(spark, members.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"),
                                                        F.collect_list(F.struct("bkey", "least")).alias("at")), "nodes")
        counts = keep_all(spark, _counts(spark, nodes.select("node", "c"), sets, slices(nodes)), "counts")
        able = counts.groupBy("node").agg(F.sum("u").alias("u"), F.sum("w").alias("w"))
        fits = F.filter("at", lambda b: (100 + percent) * F.col("u") >= percent * (
            F.col("n") + F.greatest(b["least"], F.ceil(F.col("n") * percent / 100))))
        left = nodes.join(able, "node").select("node", "n", "c", (F.col("w") / F.col("n")).alias("w"), fits.alias("at")).filter(F.size("at") > 0)
        left = keep(spark, left.select("node", "n", "c", "w", F.explode("at").alias("b")).select("b.bkey", "node", "n", "b.least", "c", "w"), "left")
        left, whole = _open(spark, left), left
        before, after = members.count(), left.count()
        discard(spark, nodes, counts, whole, members)
        members = left
        if 10 * after > 9 * before or not after:
            break
    return members


def _prefix_pairs(spark: SparkSession, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of open members of different components that can still be linked.

    With all shingles in one order, rarest first, the first common shingle of a link lies among
    the first n - need + 1 of both sets, ``need`` being the common shingles that the smallest
    possible partner asks for.  Shingles that occur in one component only are common to no such
    pair; they come first and are counted off.
    """
    nodes = members.groupBy("node", "n", "c").agg(
        F.min(F.greatest("least", F.ceil(F.col("n") * percent / 100))).alias("least"))
    need = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent))
    nodes = nodes.select("node", "n", "c", (F.col("n") - need + 1).alias("front"))
    grams = keep(spark, sets.join(nodes, "node").select("node", "n", "c", "front", F.explode("grams").alias("g")), "grams")
    crossing = _crossing(spark, grams)
    own = Window.partitionBy("node")     # one set
    front = (grams.join(crossing, "g").withColumn("u", F.count("*").over(own))
             .withColumn("place", F.row_number().over(own.orderBy("df", "g")))
             .withColumn("place", F.col("place") + F.col("n") - F.col("u"))
             .filter("place <= front").select("g", "node", "n", "c", (F.col("n") - F.col("place") + 1).alias("rest")))
    front = keep(spark, front, "front")
    discard(spark, grams, crossing)
    mixed = front.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("g")
    front, whole = keep(spark, front.join(mixed, "g"), "front"), front
    discard(spark, whole)
    # where this is the first common shingle, no more than ``rest`` of either set are common
    x, y = front.alias("x"), front.alias("y")
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.c") < F.col("y.c"))
                   & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                   & ((100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n"))))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _merge(spark: SparkSession, comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comp`` after ``links`` (a, b): components of the graph of components that they join."""
    if comp is None:
        return components(spark, links)
    named = comp.withColumnRenamed("comp", "c")
    ends = (links.join(named.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a", "left")
            .join(named.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b", "left")
            .select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    ends = keep(spark, ends, "ends")
    joined = components(spark, ends.filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    nodes = comp.union(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("comp")),
                                                     F.struct(F.col("b").alias("node"), F.col("cb").alias("comp")))).alias("x"))
                       .select("x.*")).distinct()
    new = nodes.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    new = keep(spark, new.select("node", F.coalesce("to", "comp").alias("comp")), "comp")
    discard(spark, ends)
    return new


def linked_components(spark: SparkSession, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) over the verified links within buckets; nodes without a link are absent.

    ``members``: (bkey, node, n, least), written, each bucket of two nodes or more, with the sizes of
    the node's set and of the bucket's smallest; ``sets``: (node, grams), written, with the
    sorted 64-bit shingles.
    """
    hubs = keep(spark, members.groupBy("bkey").agg(F.min("node").alias("hub")), "hubs")
    pairs = members.join(hubs, "bkey").filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    tested = _tested(spark, pairs.distinct(), sets, percent)
    comp = _merge(spark, None, tested.filter("linked").select("a", "b"))
    found, m = True, members
    used = hubs.select("bkey", F.col("hub").alias("node"))
    for turn in range(1, HUB_ROUNDS + 1):
        m = m.select("bkey", "node", "n", "least").join(comp.withColumnRenamed("comp", "c"), "node", "left") \
            .withColumn("c", F.coalesce("c", "node"))
        m = _open(spark, m)
        if anything(m):
            m = _peel(spark, m, sets, percent)
        if not anything(m):
            break
        last = not found or turn == HUB_ROUNDS
        if last:
            pairs = _prefix_pairs(spark, m, sets, percent)
        else:
            # another hub each round: the member whose shingles are the most common, so the text that
            # others were made from rather than a far copy of it
            best = F.max(F.struct("w", F.xxhash64("node").alias("h"), "node", "c"))
            hubs = keep(spark, m.join(used, ["bkey", "node"], "left_anti").groupBy("bkey").agg(best.alias("x")).select(
                "bkey", F.col("x.node").alias("hub"), F.col("x.c").alias("hc")), "hubs")
            used = used.union(hubs.select("bkey", F.col("hub").alias("node")))
            pairs = m.join(hubs, "bkey").filter("c != hc").select(
                F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        pairs = pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = _tested(spark, pairs, sets, percent)
        tested = tested.union(new)
        fresh = new.filter("linked").select("a", "b")
        found = anything(fresh)
        if found:
            comp = _merge(spark, comp, fresh)
        if last:
            break
    return comp
