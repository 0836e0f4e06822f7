"""Secret scans by character Markov models (operator 6, native).

Base kinds are patterns.  The method adds ``markov`` spans: tokens of ``MIN_TOKEN`` or more
characters of the secrets' alphabet that a first-order Markov model of random strings explains
better than one of ordinary identifiers.  Both are trained on the corpus by built-in functions:
what the base patterns catch labels random strings, all other words of the alphabet label
ordinary identifiers; character pairs are counted over all documents, with one grouped count of at most
``SIZE`` ** 2 rows per class.  A token's score is the mean log-likelihood ratio of its pairs.

The table of ratios (at most 68 x 68 numbers) is the only thing the driver sees; it becomes an
array literal that each pair indexes.

Spans are code points, end exclusive, by start and then kind as listed in ``KINDS``.  Positions
come from splitting the text at a pattern: the lengths of parts and matches add up to starts.

Defined cases: null counts as empty and has no spans.  A corpus without base spans has no random
sample; the method then adds nothing.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import table

#: The contract's patterns and lengths, and the method's token.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: access is AKIA[A-Z0-9]+ and hex [0-9a-f]+, with the least lengths below.
KINDS = ["assign", "access", "hex", "markov"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 8, 16, 32, 16

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1   # and all other characters
#: Weight, in pairs, of a character's overall share in each row of a model.
PRIOR = 500.0
#: Mean log-likelihood ratio per pair from which a token counts as random.
THRESHOLD = 0.5

SPAN = "array<struct<s:int,k:int,e:int>>"
BLOCK = 256                # matches whose places are summed at a time
#: A run that is too short holds no other match, so the length can go into the pattern.
BASE = [ASSIGN, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", f"[0-9a-f]{{{MIN_HEX},}}"]
ORDINARY = 8               # characters of an ordinary word that trains, at least


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_blocks(items: Column, zero: Column, total, add, walk) -> Column:
    """``walk(block, carry)`` (an array) of every block of ``BLOCK`` items, joined; ``carry`` is the ``add`` of the
    ``total`` of all blocks before.

    A fold that appends to an array copies it for every item.  Here it copies a block at most, so
    the work follows the number of items and not its square.
    """
    def of(items):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda bs: _let(F.transform(bs, total), lambda totals: _let(
            F.aggregate(totals, F.array(zero), lambda sums, n: F.concat(sums, F.array(add(F.element_at(sums, -1), n)))),
            lambda carries: F.flatten(F.transform(bs, lambda b, i: walk(b, F.get(carries, i)))))))

    return _let(items, of)


def _spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Spans of the pattern's matches, left to right; ``good(hits)`` is an array that tells which count.

    A match starts where the parts and matches before it end.
    """
    none = F.array().cast(SPAN)

    def step(acc, x):
        start = acc.getField("at") + x.getField("before")
        end = start + x.getField("size")
        span = F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(x.getField("ok"), F.concat(acc.getField("spans"), span))
                        .otherwise(acc.getField("spans")).alias("spans"))

    def walk(block, start):
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("spans")), step).getField("spans")

    def size(block):
        return F.aggregate(block, F.lit(0), lambda n, x: n + x.getField("before") + x.getField("size"))

    def told(hits):
        ok = F.transform(hits, lambda h: F.lit(True)) if good is None else good(hits)
        sized = F.zip_with(F.split(text, pattern, -1), hits, lambda part, hit: F.struct(
            F.length(part).alias("before"), F.length(hit).alias("size")))
        # the part after the last match has none
        steps = F.zip_with(F.slice(sized, F.lit(1), F.size(hits)), ok, lambda x, good_: F.struct(
            x.getField("before").alias("before"), x.getField("size").alias("size"), good_.alias("ok")))
        return _in_blocks(steps, F.lit(0), size, lambda a, b: a + b, walk)

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), told)).otherwise(none)


def _apart(found: Column, base: Column) -> Column:
    """The spans of ``found``, of the last kind and disjoint, that meet no span of ``base``.

    In order of their starts, a found span meets a base one if a base one before it ends after its
    start, or the next base one starts before its end.
    """
    none, last, far = F.array().cast(SPAN), len(KINDS) - 1, F.lit(2**31 - 1)

    def keep_if(stays, carry):
        """Walks a block, keeps base spans and the found ones that stay, and takes ``carry`` on."""
        def step(acc, x):
            ours = x.getField("k") == last
            return F.struct(F.when(ours, acc.getField("at")).otherwise(carry(acc.getField("at"), x)).alias("at"),
                            F.when(ours & ~stays(acc.getField("at"), x), acc.getField("spans"))
                            .otherwise(F.concat(acc.getField("spans"), F.array(x))).alias("spans"))
        return lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step).getField("spans")

    def over(zero, carry):
        return lambda block: F.aggregate(block, zero, lambda a, x: F.when(x.getField("k") == last, a).otherwise(carry(a, x)))

    def ended(a, x):
        return F.greatest(a, x.getField("e"))

    def started(a, x):
        return F.least(a, x.getField("s"))

    zero = F.lit(0)
    forward = _in_blocks(F.array_sort(F.concat(base, found)), zero, over(zero, ended), F.greatest,
                         keep_if(lambda at, x: at <= x.getField("s"), ended))
    back = _let(F.reverse(forward), lambda f: F.when(F.size(f) == 0, none).otherwise(_in_blocks(
        f, far, over(far, started), F.least, keep_if(lambda at, x: at >= x.getField("e"), started))))
    new = F.filter(back, lambda x: x.k == last)
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(new)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc, text, base): the base kinds' spans, in order."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select("doc", text.alias("text"))
    t = F.col("text")
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    return d.select("doc", "text", F.array_sort(F.concat(
        _spans(t, ASSIGN, 0, lambda hits: F.transform(values, lambda v: F.length(v) >= MIN_ASSIGN)),
        _spans(t, BASE[1], 1), _spans(t, BASE[2], 2))).alias("base"))


def _pairs(tokens: Column) -> Column:
    """All neighbouring characters of an array of tokens of two characters or more."""
    return F.flatten(F.transform(tokens, lambda t: _let(F.split(t, ""), lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y)))))


def train(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of character pairs, random over ordinary, by ``SIZE`` * first + second.

    One pass over all documents.  The labels: text within base spans is a random string (of an
    assignment its value), a word of the alphabet outside them an ordinary identifier.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(text.alias("text"))
    hits = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in BASE]
    value = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    long = F.filter(F.zip_with(hits[0], value, lambda h, v: F.when(F.length(v) >= MIN_ASSIGN, h)), lambda h: h.isNotNull())
    some = F.when(F.col("text").rlike("|".join(f"(?:{p})" for p in BASE)), F.concat(long, *hits[1:])) \
        .otherwise(F.array().cast("array<string>"))
    d = d.select("text", some.alias("some"))
    caught = F.flatten(F.transform("some", lambda h: F.regexp_extract_all(
        h, F.lit(f"[A-Za-z0-9+/_=-]{{{ORDINARY},}}"), F.lit(0))))
    plain = F.col("text")
    for pattern in BASE:
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.when(F.size("some") > 0, plain).otherwise(F.col("text"))
    words = F.regexp_extract_all(plain, F.lit(f"[A-Za-z0-9+/_=-]{{{ORDINARY},}}"), F.lit(0))
    sample = F.explode(F.array(F.struct(F.lit(True).alias("random"), caught.alias("tokens")),
                               F.struct(F.lit(False).alias("random"), words.alias("tokens"))))
    # the pairs in a column of their own: they are not repeated with each of them
    rows = (d.select(sample.alias("x")).select("x.random", _pairs(F.col("x.tokens")).alias("pairs"))
            .select("random", F.explode("pairs").alias("pair")).groupBy("random", "pair").count().collect())
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {k: [[0.0] * SIZE for _ in range(SIZE)] for k in (True, False)}
    for r in rows:
        if len(r.pair) == 2:
            counts[r.random][place.get(r.pair[0], SIZE - 1)][place.get(r.pair[1], SIZE - 1)] += r["count"]
    if not any(map(any, counts[True])):
        return None

    def model(pairs: list[list[float]]) -> list[list[float]]:
        """Log probabilities of the next character; rare rows fall back on how common it is at all."""
        common = [1.0 + sum(row[b] for row in pairs) for b in range(SIZE)]
        whole = sum(common)
        return [[math.log((row[b] + PRIOR * common[b] / whole) / (sum(row) + PRIOR)) for b in range(SIZE)] for row in pairs]

    random, ordinary = model(counts[True]), model(counts[False])
    ratios = [random[a][b] - ordinary[a][b] for a in range(SIZE) for b in range(SIZE)]
    return ratios


def _score(token: Column, ratios: Column) -> Column:
    """Mean ratio of the token's pairs."""
    def place(c):
        at = F.instr(F.lit(ALPHABET), c)
        return F.when(at > 0, at - 1).otherwise(F.lit(SIZE - 1))

    pairs = _let(F.transform(F.split(token, ""), place), lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.get(ratios, x * SIZE + y)))
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / (F.length(token) - 1)


def scan(docs: DataFrame) -> DataFrame:
    """(doc, base, spans) for every row of ``docs``, spans as arrays of (s, k, e)."""
    d = base_spans(docs)
    ratios = train(docs)
    if ratios is None:
        return d.select("doc", "base", F.col("base").alias("spans"))
    # a foldable expression: the table is one literal in the plan
    table_ = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    random = _spans(F.col("text"), f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}", 3, lambda hits: F.transform(hits, lambda h: _score(h, table_) > THRESHOLD))
    d = d.select("doc", "base", random.alias("found"))
    return d.select("doc", "base", F.array_sort(F.concat("base", _apart(F.col("found"), F.col("base")))).alias("spans"))


def _told(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda b: b.k == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc.doc_id", of(0), of(1), of(2), F.sha2(_told("base"), 256).alias("base_sha256"),
                        _told("spans").alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLE: dict[str, str] = {}
