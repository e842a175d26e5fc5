"""The pipeline's stages, one after the other, against what they promise."""

import corpus_pipeline
from strandline.llm import decontaminate, packing, simhash
from strandline.llm.common import written
from tests.llm.helpers import docs_of, edge_texts

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, kept[-1], SF))
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= kept[-1].count(), name
            assert out.where("n_chars <> length(text)").count() == 0
        kept.append(out)
    unique = simhash.report(kept[3])
    assert unique.where("doc_id <> component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.report(kept[4], bench).where("n_hit > 0 AND n_words >= 10").count() <= 1
    ids = {r.doc_id for r in kept[4].collect()}
    pieces = kept[5].collect()
    assert {p.doc_id for p in pieces} == ids
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_bear_edge_rows_and_empty_tables(spark):
    for rows in (edge_texts(), []):
        docs = docs_of(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF))
            assert name == "packing" or docs.columns == columns
        assert docs.columns == packing.pack(docs_of(spark, [])).drop("ids").columns
