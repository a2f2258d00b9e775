"""Every stage of the pipeline on nulls, empty tables and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASH = ("kept", "score", "predicted", "n_words", "base_failed", "component_id", "is_representative", "n_bytes", "n_spans", "ids", "__cls", "__once", "a.b")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs, labels):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, folder, docs, empty, name, stage):
    clash = docs.withColumns({c: F.lit("mine") for c in CLASH})
    out = stage(spark, clash, folder)
    assert stage(spark, empty, folder).count() == 0
    if name == "packing":
        assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
        return
    assert out.columns == clash.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in CLASH) and len(rows) <= docs.count()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    if name == "suffixes":
        assert len(rows) == docs.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    else:
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts


def test_jaccard_stage_keeps_one_of_each_group(spark, folder, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, folder).collect()}
    # 0, 1 and 2 are near copies, 7 and 8 exact ones, 4 to 6 have no words
    assert {0, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, None} == kept


def test_run_packs_what_the_stages_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = [r["doc_id"] for r in docs.collect()]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r["doc_id"] for r in pieces}) == sorted(kept)
    assert all(len(np.frombuffer(bytes(r["ids"]), "<u4")) == r["length"] for r in pieces)
