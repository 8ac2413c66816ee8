import pytest

import corpus_pipeline
from helpers import documents
from revlens.llm import decontam, language, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    """Each stage keeps rows of its input as they are, and what it keeps follows the verdicts of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: tuple(r) for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = out.collect()
        ids = {r["doc_id"] for r in after}
        assert all(tuple(r)[: len(columns)] == before[r["doc_id"]] for r in after) and len(ids) == len(after)
        if k == 0:
            good = {r["doc_id"] for r in quality.verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
        elif k == 1:
            rows = docs.selectExpr("doc_id as id", "text", "lang as declared", "source as host")
            good = {r["id"] for r in language.identify(rows).filter("accepted").collect()}
        elif k == 2:
            good = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif k == 3:
            good = set(before) - {r["doc_id"] for r in decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            good = ids
            assert out.columns == [*columns, "copies"] and all(1 <= r["copies"] <= 3 for r in after)
        assert ids == good, name
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("rows", [None, 0])
def test_odd_and_empty_tables(spark, rows):
    docs = documents(spark)
    docs = docs if rows is None else docs.limit(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if _ != "mixing sources to target weights" else docs.schema.add("_copies", "long"))
