import hashlib

import pytest
from pyspark.sql import functions as F

from chainlens.llm import fill_middle as M
from tests.llm.common import COLUMNS, frame, prose, save


def by_hand(doc_id, units):
    """(n, form, prefix_chars, middle_chars, output) by a loop over the units."""
    text, n = "".join(units), len(units)
    x = hashlib.sha256(b"1:%s" % str(doc_id).encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    first, second = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p = m = s = ""
    for i, u in enumerate(units):
        if i < first:
            p += u
        elif i < second:
            m += u
        else:
            s += u
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


TEXTS = ["a", "ab\n\ncd", "añ€😀 b" * 30, "<<P", "x<P>y", "<S><M>", "ends with <", "S>", "<", "\x00\t ", prose(400, 1)]


def test_equals_a_loop_and_round_trips(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(-7, "minus"), (1000, "long " * 200_000)]
    cut = M.fill_in_middle(frame(spark, rows)).withColumn("back", M.restored())
    got = {r.doc_id: r for r in cut.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert tuple(r)[1:6] == by_hand(i, list(text))
        assert r.back == text
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_query(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)]
    got = M.op13_fill_in_middle(spark, save(frame(spark, rows), tmp_path)).collect()
    for r in got:
        n, form, a, b, out = by_hand(r.doc_id, list(rows[r.doc_id][1]))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()


def test_other_units(spark):
    """Cuts between words, each with the space before it."""
    rows = [(i, prose(1 + i % 50, i)) for i in range(100)]
    got = M.fill_in_middle(frame(spark, rows), r"\s*\S+").withColumn("back", M.restored()).collect()
    for r in got:
        ws = rows[r.doc_id][1].split(" ")
        assert tuple(r)[1:6] == by_hand(r.doc_id, [w if i == 0 else " " + w for i, w in enumerate(ws)])
        assert r.back == rows[r.doc_id][1]
    # a text that the units do not cover stays as it is
    r = M.fill_in_middle(frame(spark, [(1, "ab  ")]), r"\s*\S+").first()
    assert (r.n, r.form, r.output) == (1, "plain", "ab  ")
    with pytest.raises(ValueError):
        M.fill_in_middle(frame(spark, rows), ".*")


def test_long_texts_are_matched_in_blocks():
    text = "añb c😀" * 5000
    assert M.Cutter(block=1000).ends(text) == M.Cutter().ends(text) == list(range(1, len(text) + 1))
    words = M.Cutter(r"\s*\S+", block=100)
    assert words.ends(text) == M.Cutter(r"\s*\S+").ends(text)
    assert words.ends(text + " ")[-1] == len(text)


def test_odd_rows(spark):
    rows = [(None, None), (None, "no id"), (5, ""), (6, None), (8, "same"), (8, "same")]
    got = M.fill_in_middle(frame(spark, rows)).withColumn("back", M.restored()).collect()
    assert sorted((r.n, r.back) for r in got) == [(0, ""), (0, ""), (0, ""), (4, "same"), (4, "same"), (5, "no id")]
    assert len({tuple(r) for r in got if r.doc_id == 8}) == 1
    assert all(r.form == "plain" and r.prefix_chars is None for r in got if r.n == 0)
    assert M.fill_in_middle(spark.createDataFrame([], COLUMNS)).count() == 0
    assert M.fill_in_middle(frame(spark, rows)).filter(F.col("n").isNull()).count() == 0
