from pyspark.sql import functions as F

import corpus_pipeline
from chainlens.llm.scratch import keep, table
from tests.llm.common import words

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "packing"]
    docs = table(spark, SF, "documents").filter("doc_id < 120")     # small enough for a unit test
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = keep(spark, docs, "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    kept = docs.select("doc_id", "text").collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    starts = packed.filter("start = 0").groupBy("doc_id").count().collect()
    copies = {}
    for r in kept:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {r.doc_id: r["count"] for r in starts} == copies and max(copies.values()) <= 3
    assert all(len(words(r.text)) >= 50 for r in kept)



def test_run_applies_the_stages_in_order(spark, monkeypatch):
    """``run`` writes each stage's rows and hands them to the next one."""
    def stage(n):
        return lambda s, docs, sf_dir: docs.filter(docs.doc_id % 10 != n).withColumn("text", F.concat("text", F.lit(str(n))))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage {n}", stage(n)) for n in (1, 2, 3)])
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.text.endswith("123") and r.doc_id % 10 not in (1, 2, 3) for r in out)
