import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from chainlens.llm import packing
from tests.llm.common import COLUMNS, frame, prose

EXACT = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TEXTS = [None, "", " ", "a", "Hello, world's end", "  two  spaces\n\n\tand tabs \r\n", "x" * 5000, "naïve façade — “quoted” … €5",
         "日本語のテキスト と english", "emoji 🙂🙂 here", "<|endoftext|> inside <|endoftext|>", "a b c\u0085d\u001ce",
         "١٢٣ 45 ½ ²", "don't we'll they've I'm it's you're he'd", prose(3000, 1), prose(900, 2), "é" * 900, "́ͅ combining"]


def ids(text):
    return np.array(EXACT.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(pieces, rows):
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        all_ids, at = ids(texts[d]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(all_ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(all_ids[r.start:at].tobytes())
        assert at == len(all_ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding / total


def test_pieces_hold_every_id_once(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, prose(10 + 7 * i % 800, i)) for i in range(150)]
    assert check(packing.pack_documents(spark, frame(spark, rows)).collect(), rows) < 0.02


@pytest.mark.parametrize("text", TEXTS)
def test_both_encoders_agree(text):
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = packing.encoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), ranks, P.PATTERN)
    assert encode(text or "").tolist() == ids(text)[:-1].tolist()


def test_dot_product_holds_all_limits():
    rng = np.random.default_rng(3)
    demand = np.column_stack([rng.integers(1, 1024, 800), np.ones(800), rng.integers(0, 400, 800)]).astype(float)
    capacity = np.array([1024, 4, 600.0])
    bins = packing.dot_product(demand, capacity)
    assert sorted(i for b in bins for i in b) == list(range(800))
    assert all((demand[b].sum(axis=0) <= capacity + 1e-9).all() for b in bins)
    bound = max(np.ceil(demand.sum(axis=0) / capacity))
    assert len(bins) <= 1.15 * bound


def test_empty_null_and_repeated(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], COLUMNS)).count() == 0
    got = packing.pack_documents(spark, frame(spark, [(None, "a"), (1, "b"), (1, "b"), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 2), (1, 2), (1, 2), (2, 1)]


def test_a_loss_limit_that_binds(spark):
    """Conversations: loss = the words of the assistant's turns, with a limit below that of the tokens."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr(
        "conv_id", "size(split(trim(text), '\\\\s+')) AS n", "role = 'assistant' AS answer")
    items = turns.groupBy("conv_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "tokens").join(
        turns.filter("answer").groupBy("conv_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "loss"), "conv_id", "left")
    items = items.fillna(0, ["loss"]).selectExpr("conv_id", "tokens", "1 AS segments", "loss").filter("tokens <= 1024 AND loss <= 400")
    want = {r.conv_id: r for r in items.collect()}

    def place(pdf, bins, base):
        return pdf.assign(bin=[base + next(k for k, b in enumerate(bins) if i in b) for i in range(len(pdf))])[["conv_id", "bin"]]

    def pack(loss):
        out = {}
        rows = packing.pack_vectors(items, "conv_id long, bin long", place, len(want), ["conv_id"], [1024, 16, loss], 64).collect()
        assert sorted(r.conv_id for r in rows) == sorted(want)
        for r in rows:
            out.setdefault(r.bin, []).append(want[r.conv_id])
        return out.values()

    tight, idle = pack(400), pack(1024)
    for b in tight:
        assert sum(r.tokens for r in b) <= 1024 and len(b) <= 16 and sum(r.loss for r in b) <= 400
    assert any(sum(r.loss for r in b) > 400 for b in idle)


def test_repeated_rows_are_dealt_to_many_groups(spark):
    """Identical rows, with an id and without: whole, and in groups of the usual size."""
    rows = [(None, "the same text")] * 9000 + [(7, "another one")] * 6000 + [(1000 + i, prose(20, i)) for i in range(500)]
    got = packing.pack_documents(spark, frame(spark, rows)).collect()
    assert len(got) >= len(rows)
    groups = {}
    for r in got:
        groups[r.sequence_id >> 33] = groups.get(r.sequence_id >> 33, 0) + 1
    sizes = sorted(groups.values())
    assert len(sizes) == -(-len(rows) // packing.GROUP) and sizes[-1] < 1.5 * packing.GROUP
    by_id = {}
    for r in got:
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + r.length
    assert by_id[None] == 9000 * len(ids("the same text")) and by_id[7] == 6000 * len(ids("another one"))
