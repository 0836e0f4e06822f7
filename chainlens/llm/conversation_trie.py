"""Conversation prefix trie by truncation peeling (operator 11).

A node is a distinct run of first turns (role, text); the root is the run of none.  The trie is
discovered from its deepest level up.  At a depth, the conversations that end there and the nodes
that survive from the level below, stripped of their last turn, are grouped by what they have
left; every group is a node, and its counts are complete because all of its subtree has arrived
with it.  So members, children, leaves and saved words are aggregated while nodes are found.

A conversation is a chain of one 128-bit hash per prefix, each made from the last one and the turn's
digest, so a node's key is one hash whatever its depth.  Conversations with equal chains collapse
first.  Levels are peeled in blocks: the rows below a depth are dealt by their prefix of that depth
and peeled in the tasks, if no such prefix holds more than ``GROUP`` rows; where even the deepest
prefix is hotter than that, this one level is a grouped aggregation with partial sums.  Hot first
turns (a common system prompt) thus never meet in one task, and a few very long conversations
cost no job per level.

The ids that end at a node are hashed in order from joined runs of at most ``RUN`` ids, which are made
in parallel over ranges of (node, id); the hash of one node streams over its runs.

Defined cases: turns go by ``turn``, null first; ties by the digest of role and text, and repeated
rows are turns each.  Null roles and texts become empty.  Rows with a null ``conv_id`` belong to no
conversation and are left out.  An empty table has no conversation and no node, not even a root.
Extra columns are ignored.  A conversation must fit in a task as 24 bytes per turn.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import discard, keep, table

ROOT = b""
KEY = 16                  # bytes of a prefix's hash
GROUP = 512
RUN = 4096

ROWS = ("depth int, chain binary, words array<int>, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved long")
NODES = ("key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, as (turn, digest of role and text, words of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    d = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.unhex(F.md5(told.cast("binary"))).alias("digest"),
                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t"))
    return d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))    # of one conversation


def rebuilt(spark: SparkSession, conversations: DataFrame, heads: int = 4, family: int = 20) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % ``family``, then c's own after its first h.

    h = crc32(c) % ``heads``.  Without the other conversation its part is empty.
    """
    own = keep(spark, turns(conversations), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    both = (own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
            .withColumn("head", F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h")))
            .withColumn("tail", F.slice("turns", F.col("h") + 1, F.size("turns"))))
    return both.select("conv_id", F.concat("head", "tail").alias("turns"))


def chains(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, chain, words): the hashes of all prefixes, ``KEY`` bytes each, and the words of all turns."""
    def hashed(batches):
        for b in batches:
            depths, out, words = [], [], []
            for digests, counts in zip(b.column(1).to_pylist(), b.column(2)):
                key, parts = ROOT, []
                for d in digests:
                    key = xxhash.xxh3_128_digest(key + d)
                    parts.append(key)
                depths.append(len(parts))
                out.append(b"".join(parts))
                words.append(counts.values.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(depths, pa.int32()), pa.array(out, pa.binary()), pa.array(words, pa.list_(pa.int32()))],
                ["conv_id", "depth", "chain", "words"])

    return convs.select("conv_id", "turns.digest", "turns.words").mapInArrow(
        hashed, "conv_id long, depth int, chain binary, words array<int>")


def prefix(depth) -> Column:
    """The key of a chain's prefix of so many turns."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring("chain", (d - 1) * KEY + 1, F.when(d > 0, F.lit(KEY)).otherwise(F.lit(0)))


def ends(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256): of every prefix at which conversations end, the hash of their ids."""
    def runs(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        done = [[], [], []]
        for key, own in groupby(rows, lambda r: r[0]):
            some = []
            for _, conv_id in own:
                some.append(conv_id)
                if len(some) == RUN:
                    _put(done, key, some)
                    some = []
            if some:
                _put(done, key, some)
            if len(done[0]) >= RUN:
                yield _batch(done)
                done = [[], [], []]
        yield _batch(done)

    def _put(done, key, ids):
        for column, v in zip(done, (key, ids[0], ",".join(map(str, ids)))):
            column.append(v)

    def _batch(done):
        return pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())],
                                          ["key", "first", "ids"])

    def digests(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1)))
        keys, out = [], []
        for key, own in groupby(rows, lambda r: r[0]):
            sha, more = hashlib.sha256(), b""
            for _, ids in own:
                sha.update(more + ids.as_py().encode())
                more = b","
            keys.append(key)
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])

    ids = convs.select(prefix(F.col("depth")).alias("key"), "conv_id")
    joined = (ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(runs, "key binary, first long, ids string"))
    return (joined.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(digests, "key binary, ends_sha256 string"))


OUT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
       "ends_sha256 string")


class Level(dict):
    """Nodes of one depth by key: [conv_id, n_convs, n_children, n_leaves, saved, chain, words]."""

    def meet(self, key, conv_id, n_convs, n_children, n_leaves, saved, chain, words):
        node = self.get(key)
        if node is None:
            self[key] = [conv_id, n_convs, n_children, n_leaves, saved, chain, words]
            return
        node[0] = min(node[0], conv_id)
        node[1] += n_convs
        node[2] += n_children
        node[3] += n_leaves
        node[4] += saved


def peel(rows, low: int):
    """The nodes deeper than ``low`` of one prefix of that depth, and what survives of it there.

    ``rows``: tuples as in ``ROWS``.  Nodes are tuples as in ``NODES``, the survivor one as in ``ROWS``.
    """
    levels: dict[int, Level] = {}
    for depth, chain, words, *counts in rows:
        levels.setdefault(depth, Level()).meet(chain[-KEY:], *counts, chain, words)
    nodes = []
    for depth in range(max(levels), low, -1):
        above = levels.setdefault(depth - 1, Level())
        for key, (conv_id, n, children, leaves, saved, chain, words) in levels.pop(depth).items():
            leaves = leaves or 1
            saved += (n - 1) * words[depth - 1]
            parent = chain[(depth - 2) * KEY:(depth - 1) * KEY] if depth > 1 else ROOT
            nodes.append((key, parent, depth, conv_id, n, children, leaves, saved))
            above.meet(parent, conv_id, n, 1, leaves, saved, chain, words)
    survivors = [(low, chain[:low * KEY], words[:low], conv_id, n, children, leaves, saved)
                 for conv_id, n, children, leaves, saved, chain, words in levels[low].values()]
    return nodes, survivors


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _kind(schema: str) -> pa.StructType:
    return pa.struct([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _structs(rows: list[tuple], schema: str, before: int, after: int) -> pa.Array:
    """``rows`` as structs, between nulls."""
    kind = _kind(schema)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind]
    return pa.concat_arrays([pa.nulls(before, kind), pa.StructArray.from_arrays(columns, fields=list(kind)), pa.nulls(after, kind)])


def _peel_block(rows: DataFrame, low: int) -> DataFrame:
    """(node, row): the nodes deeper than ``low``, and the rows that survive at ``low``."""
    def out(nodes, left):
        return pa.RecordBatch.from_arrays([_structs(nodes, NODES, 0, len(left)), _structs(left, ROWS, len(nodes), 0)], ["node", "row"])

    def peeled(batches):
        dealt = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        nodes, left = [], []
        for _, own in groupby(dealt, lambda r: r[0]):
            n, s = peel((r[1:] for r in own), low)
            nodes += n
            left += s
            if len(nodes) >= RUN:
                yield out(nodes, left)
                nodes, left = [], []
        yield out(nodes, left)

    def told(schema: str) -> str:
        return "struct<" + schema.replace(" ", ":").replace(",:", ", ") + ">"

    dealt = rows.select(prefix(low).alias("at"), *_kind(ROWS).names).repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(peeled, f"node {told(NODES)}, row {told(ROWS)}")


def _peel_level(rows: DataFrame, depth: int) -> DataFrame:
    """(node, row) of one level: grouped by key with partial sums, whatever a group's size."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = rows.groupBy(prefix(depth).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), *sums, F.first("chain").alias("chain"), F.first("words").alias("words"))
    word = F.get("words", F.lit(depth - 1)) if depth else F.lit(0)
    nodes = (nodes.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))
             .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * word))
    node = F.struct("key", prefix(max(depth - 1, 0)).alias("parent"), F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children",
                    "n_leaves", F.col("saved").alias("saved_tokens"))
    up = max(depth - 1, 0)
    row = F.struct(F.lit(up).alias("depth"), F.substring("chain", 1, up * KEY).alias("chain"), F.slice("words", 1, up).alias("words"),
                   "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
    return nodes.select(node.alias("node"), row.alias("row"))


def _block(rows: DataFrame, high: int, group: int) -> int | None:
    """The least depth below ``high`` of which no prefix holds more than ``group`` deeper rows, if any.

    Depths that are tried: all up to 8, then every second power of two's half step, and ``high`` - 1.
    """
    tried = sorted({d for d in range(9) if d < high} | {d for e in range(3, 40) for d in (1 << e, 3 << e >> 1) if d < high} | {high - 1})
    at = rows.select("depth", "chain", F.explode(F.array(*map(F.lit, tried))).alias("low")).filter("depth > low")
    sizes = at.groupBy("low", prefix(F.col("low")).alias("key")).count().groupBy("low").agg(F.max("count").alias("most"))
    fits = [r.low for r in sizes.collect() if r.most <= group]      # one row per depth tried
    return min(fits, default=None)


def trie(spark: SparkSession, convs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per node of the trie over ``convs`` (conv_id, turns)."""
    linked = keep(spark, chains(convs), "chains")
    zero = F.lit(0).cast("long")
    rows = keep(spark, linked.groupBy(prefix(F.col("depth")).alias("key"), "depth").agg(
        F.first("chain").alias("chain"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .select("depth", "chain", "words", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved")), "tips")
    high = rows.agg(F.max("depth")).first()[0]
    found = []
    waiting = rows                       # conversations that end above the levels peeled so far
    while high is not None and high >= 0:
        low = _block(rows, high, group) if high else None
        if low is None:
            done = _peel_level(rows.filter(F.col("depth") == high), high)
            low = high - 1
        else:
            done = _peel_block(rows.filter(F.col("depth") > low), low)
        done = keep(spark, done, "peeled")
        found.append(done.filter("node IS NOT NULL").select("node.*"))
        left = done.filter("row IS NOT NULL").select("row.*")
        rows = waiting.filter(F.col("depth") <= low).unionByName(left)
        high = low
    if not found:
        return spark.createDataFrame([], OUT)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    above = F.when(F.col("depth") > 0, F.col("parent"))
    return (nodes.withColumn("parent", above).join(parents, "parent", "left").join(keep(spark, ends(spark, linked), "ends"), "key", "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, rebuilt(spark, table(spark, sf_dir, "conversations")))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLE = {"op11_conversation_trie": """
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
told AS (SELECT *, md5(length(r) || ':' || r || x) AS m FROM own),
t AS (SELECT conv_id, m, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k FROM told),
ids AS (  -- crc32 of the decimal id, bit by bit
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT i.conv_id, 0 AS part, t.k, t.m, t.x FROM ids i JOIN t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL SELECT i.conv_id, 1, t.k, t.m, t.x FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.k > i.h),
s AS (SELECT conv_id, m, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w,
             row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM parts),
members AS (
  SELECT conv_id, 0 AS d, '' AS key, 0 AS w FROM ids
  UNION ALL SELECT conv_id, d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d), w FROM s),
nodes AS MATERIALIZED (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w FROM members GROUP BY key, d),
children AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT substr(u.key, 1, 32 * e.d) AS key, sum((u.n - 1) * u.w) AS saved, count(*) FILTER (c.key IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) u JOIN (SELECT DISTINCT d FROM nodes) e ON e.d = u.up
  LEFT JOIN children c ON c.key = u.key GROUP BY 1),
last AS (SELECT conv_id, max_by(key, d) AS key FROM members GROUP BY conv_id),
ended AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM last GROUP BY key)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(x.ends, sha256('')) AS ends_sha256
FROM nodes v JOIN below b ON b.key = v.key LEFT JOIN children c ON c.key = v.key LEFT JOIN ended x ON x.key = v.key
LEFT JOIN nodes p ON v.d > 0 AND p.key = substr(v.key, 1, 32 * (v.d - 1))"""}
