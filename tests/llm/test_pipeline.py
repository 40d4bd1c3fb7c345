from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_packing import check
from tests.llm.test_suffixes import brute_passages

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(90_001).cast("long"))
    again = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 80_000)
    docs = docs.unionByName(extra).unionByName(again)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in rows}
            assert after.keys() <= before.keys()
            if k < 3:
                assert all(after[i] == before[i] for i in after)
            gone = before.keys() - after.keys()
        if name == "language":
            assert gone == {90_001}
        if name == "quality":
            assert sum(labels.get(i) == 1 for i in gone) <= 3 and sum(labels.get(i) == 0 for i in after) <= 3
        if name == "near_dedup":
            assert not {i for i in after if i >= 80_000} and len(set(after.values())) == len(after)
        if name == "suffix_dedup":
            ids = sorted(before)
            want = brute_passages([before[i] for i in ids], 200, 50)
            assert [after[i] for i in ids] == [before[i] if not n else left.decode("utf-8", "ignore") for i, (n, left) in zip(ids, want, strict=True)]
            assert any(n for n, _ in want)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "packing":
            check(sorted(before.items()), [r.asDict() for r in rows], 2048)
        before = after


@pytest.mark.parametrize("columns", ["doc_id long, text string, lang string, source string, n_chars long"])
def test_empty_corpus(spark, columns):
    docs = spark.createDataFrame([], columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if name != "packing" else docs
