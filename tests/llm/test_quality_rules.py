import re
from collections import Counter

from chainlens.llm import quality_rules as Q
from tests.llm.common import COLUMNS, frame, prose

REPEAT = "buy now cheap " * 40
TEXTS = [None, "", " \n ", "one", "a b a b a b a b", REPEAT, prose(60, 1), prose(60, 2) + "\n" + prose(8, 3) + "\n" + prose(8, 3),
         "é ü\tx\r\ny\n\ny\n y", prose(20_000, 4) + " " + prose(500, 5) + " " + prose(500, 5), "# * $ % & | < > [a] {b}", "a\n\n\na\na"]


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_brute_force(spark):
    got = Q.measure(frame(spark, list(enumerate(TEXTS)))).select("doc.doc_id", "m.*", Q.base_failed().alias("failed")).collect()
    for r in got:
        want = base(TEXTS[r.doc_id])
        assert tuple(r[c] for c in Q.BASE) == want
        assert r.failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert len(got) == len(TEXTS)


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        kind = i % 8
        text = prose(80 + i % 90, i)
        if kind == 0:
            text = " ".join(w + "%%$" for w in text.split())
        elif kind == 1:
            text = text.upper()
        rows.append((i, text))
        if i % 2 == 0 or kind == 1:
            labels.append((i, int(kind > 1), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list_rejects_junk_and_keeps_prose(spark):
    docs, labels = labelled(spark)
    rules = Q.learn(spark, docs, labels)
    assert rules and all(1 <= len(r) <= Q.MAX_TESTS for r in rules)
    verdicts = {r.doc_id: r.kept for r in Q.judge(spark, docs, labels).select("doc.doc_id", "kept").collect()}
    assert verdicts == {i: i % 8 > 1 for i in range(400)}


def test_without_labels_the_base_decides(spark):
    docs, labels = labelled(spark, 40)
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.selectExpr("doc_id", "7 AS quality", "toxic")):
        assert Q.learn(spark, docs, some) == []
    assert Q.judge(spark, docs, labels.limit(0)).filter("kept").count() == 40


def test_stage_and_empty_table(spark, tmp_path):
    docs, labels = labelled(spark, 80)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    empty = spark.createDataFrame([], COLUMNS)
    assert Q.stage(spark, empty, str(tmp_path)).count() == 0


def test_verdict_is_an_ordered_expression(spark):
    rules = [[("symbols", True, 10.0)], [("upper", True, 500.0), ("word_length", False, 3000.0)]]
    row = spark.sql("SELECT struct(5D AS symbols, 600D AS upper, 2000D AS word_length) AS m")
    assert row.select(Q.verdict(rules).alias("v")).first().v is False
    assert row.select(Q.verdict(rules[:1]).alias("v")).first().v is True
    assert row.select(Q.verdict([]).alias("v")).first().v is True
