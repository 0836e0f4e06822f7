"""Packing by vector bin packing (operator 8).

Tokens: byte-level BPE ids of the whole text, then id 0.  A document longer than a sequence
fills whole sequences on its own; what is left of each document (fewer than 1024 ids) is an
item with a demand vector: tokens, segments, loss-bearing tokens.  Items are dealt by a hash
into groups of about ``GROUP``, and in each group the dot-product heuristic fills one bin at a
time: of the items that fit, the one with the largest weighted dot product of its demand and the
bin's free capacity.  A bin that stays far from full is cut at powers of two, the lengths at
which a sequence needs no padding.  Groups are independent, bounded and seeded by the ids
alone, so no task grows with the input and reruns agree.

:func:`pack_vectors` packs any examples with such demands (instruction data: loss-bearing
tokens are those of the assistant's turns); :func:`pack_documents` adds the tokens.

Ids: ``tokenizers`` is the reference.  ``tiktoken`` holds the same vocabulary as ranks and gives
the same ids at three times the speed; it takes the texts of Latin letters and common
punctuation, where both libraries split words alike, and ``tokenizers`` takes all others and
texts that spell a special token.

Defined cases: a null or empty text is the single id 0.  A null ``doc_id`` is carried.  Rows
that repeat an id are packed each.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.scratch import keep, table

LENGTH = 1024
MAX_SEGMENTS = 64
GROUP = 4096
#: A bin with more free tokens than this is cut at powers of two instead of padded.
SLACK = 32
END_ID = 0
#: Both libraries split these alike: ASCII, Latin letters, general punctuation, euro, trade mark.
COMMON = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€™]*"

CUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def encoder(json_text: str, ranks: dict[bytes, int], pattern: str):
    """A function from a text to its ids as little-endian uint32."""
    import re

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_str(json_text)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    common = re.compile(COMMON).fullmatch

    def encode(text: str) -> np.ndarray:
        # a text of few, very long words goes to tokenizers, whose merges cope with those
        if common(text) and not any(s in text for s in special) and len(text) < 2000 + 200 * text.count(" "):
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def cut_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None,
                  length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids; ``ids`` is set for what is shorter than a sequence.

    The vocabulary (two files of fixed size, about 1 MB each) is read on the driver and sent to
    the tasks.
    """
    import base64

    import public_tokenizers as P

    path = tokenizer_path or P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        json_text = f.read()
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = spark.sparkContext.broadcast((json_text, ranks, P.PATTERN))

    def cut(batches):
        encode = encoder(*vocabulary.value)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_py() or "").tobytes() + end
                n = len(raw) // 4
                for start in range(0, n, length):
                    piece = raw[4 * start:4 * (start + length)]
                    size = len(piece) // 4
                    for column, v in zip(out, (doc_id, start, size, zlib.crc32(piece), n, piece if size < length else None)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(out)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, CUT)


def dot_product(demand: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Bins as lists of item numbers; ``demand`` is (items, dimensions), each within capacity.

    Demands count as shares of the capacity, and a dimension weighs as much as the items ask of
    it in total (the usual weights of the heuristic).
    """
    share = demand / capacity
    weight = share.sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    order = np.argsort(-(share @ weight), kind="stable")
    left = share[order]
    bins: list[list[int]] = []
    while len(order):
        free, chosen, open_ = np.ones(share.shape[1]), [], np.ones(len(order), bool)
        fits = open_
        while True:
            score = np.where(fits, left @ (weight * free), -1.0)
            best = int(score.argmax()) if len(score) else 0
            if not len(score) or score[best] < 0:
                break
            chosen.append(int(order[best]))
            free = free - left[best]
            open_[best] = False
            fits = open_ & (left <= free + 1e-12).all(axis=1)
        bins.append(chosen)
        order, left = order[open_], left[open_]
    return bins


def pack_vectors(items: DataFrame, schema: str, place, n_items: int, key: list[str], capacity: list[int],
                 group: int = GROUP, number: str | None = None) -> DataFrame:
    """Packs ``items`` (with columns tokens, segments, loss) in groups of about ``group``.

    ``key`` orders the items and deals them to groups; ``number``, a column that tells all items of a
    written table apart, deals those that share a key.

    ``place(pdf, bins, base)`` gives a group's rows with the columns of ``schema``; ``base`` is
    the number of the group's first sequence.
    """
    groups = max(1, -(-n_items // group))
    limits = np.array(capacity, float)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["group"].iloc[0])
        pdf = pdf.sort_values(["spot", *key], kind="mergesort").reset_index(drop=True)
        bins = dot_product(pdf[["tokens", "segments", "loss"]].to_numpy(float), limits)
        return place(pdf, bins, number << 32)

    spot = F.xxhash64(*key)
    if number:
        # items that repeat a key would be one group: their numbers deal them
        again = items.groupBy(spot.alias("twin")).agg(F.count("*").alias("m")).filter("m > 1").select("twin")
        again = keep(items.sparkSession, again.withColumn("again", F.lit(True)), "pack-again")
        items = items.withColumn("twin", spot).join(again, "twin", "left")
        spot = F.when(F.col("again"), F.xxhash64("twin", number)).otherwise(F.col("twin"))
    return (items.withColumn("spot", spot).withColumn("group", F.pmod(F.col("spot"), F.lit(groups)))
            .groupBy("group").applyInPandas(pack, schema))


def lay_out(pdf: pd.DataFrame, bins: list[list[int]], base: int, length: int = LENGTH, slack: int = SLACK) -> pd.DataFrame:
    """Rows of pieces with sequence and offset; far from full bins are cut at powers of two."""
    rows, sequence = [], base
    doc_id, start, ids, doc_tokens = (pdf[c].tolist() for c in ("doc_id", "start", "ids", "doc_tokens"))
    for chosen in bins:
        total = sum(len(ids[i]) // 4 for i in chosen)
        if total == length or length - total <= slack:
            ends = [total]
        else:
            ends, at = [], 0
            for bit in reversed(range(total.bit_length())):
                if total >> bit & 1:
                    ends.append(at := at + (1 << bit))
        at, offset, stop = 0, 0, iter(ends)
        end = next(stop)
        for i in chosen:
            raw, pos, n = ids[i], 0, len(ids[i]) // 4
            while pos < n:
                take = min(n - pos, end - at)
                rows.append((doc_id[i], start[i] + pos, take, zlib.crc32(raw[4 * pos:4 * (pos + take)]),
                             doc_tokens[i], 2 * sequence + 1, offset))
                pos, at, offset = pos + take, at + take, offset + take
                if at == end:
                    sequence, offset, end = sequence + 1, 0, next(stop, None)
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece, see ``PIECES``; whole sequences have even numbers, packed ones odd."""
    cut = cut_documents(spark, docs, tokenizer_path)
    cut = keep(spark, cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter("ids IS NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("piece")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = cut.filter("ids IS NOT NULL")
    ended = F.col("start") + F.col("length") == F.col("doc_tokens")
    items = rest.select("doc_id", "start", "ids", "doc_tokens", "ids_crc32", "piece", F.col("length").alias("tokens"),
                        F.lit(1).alias("segments"), (F.col("length") - ended.cast("long")).alias("loss"))
    packed = pack_vectors(items, PIECES, lay_out, rest.count(), ["doc_id", "start", "ids_crc32"],
                          [LENGTH, MAX_SEGMENTS, LENGTH], number="piece")
    return whole.union(packed)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their places."""
    return pack_documents(spark, docs)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
ORACLE: dict[str, str] = {}
