import hashlib
from collections import defaultdict

import pytest

from chainlens.llm import exact_dup
from tests.llm.common import COLUMNS, frame, prose

LONG = prose(30_000, 1)
ROWS = [(1, "same text"), (2, "same text"), (3, "Same text"), (4, None), (5, ""), (6, None), (None, "same text"),
        (7, LONG), (8, LONG), (9, LONG[:-1] + "!"), (9, "twice"), (9, "twice"), (10, prose(300, 2)),
        (11, prose(300, 2)[:-1] + "?"), (12, "é" * 40), (13, "é" * 40), (14, "ab"), (15, "ba")]


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(-1 if d is None else d)
    out = []
    for d, t in rows:
        best = max(groups[t or ""])
        out.append((d, best, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_by_whole_bytes(spark):
    got = exact_dup.exact_duplicates(spark, frame(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}           # ties included: exactly one of equal texts stays


def test_stage_keeps_columns_and_one_of_each(spark):
    docs = frame(spark, ROWS)
    out = exact_dup.stage(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert exact_dup.exact_duplicates(spark, docs).count() == 0
    assert exact_dup.stage(spark, docs, "").count() == 0


@pytest.mark.parametrize("first,growth", [(1, 2), (3, 5)])
def test_digits_of_any_width_agree(spark, monkeypatch, first, growth):
    monkeypatch.setattr(exact_dup, "FIRST_DIGIT", first)
    monkeypatch.setattr(exact_dup, "GROWTH", growth)
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 3000]
    got = exact_dup.exact_duplicates(spark, frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
