"""A text that is longer than a slice and than an Arrow batch, in every operator on texts and in the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavesift.llm import fim, jaccard, packing, pieces, quality, secret_scan, substrings, suffixes, toxicity

WORDS = 1_100_000


@pytest.fixture(scope="module")
def long(spark):
    text = " ".join(f"w{i * 7919 % 2_000_003}" for i in range(WORDS))
    assert len(text) > 8 << 20
    return spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "a short one", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).persist()


def first(df):
    return df.where("doc_id = 1").first()


def test_exact_operators(long):
    whole = first(long)["text"]
    r = first(substrings.dedup(long))
    assert (r.n_words, r.n_removed, r.kept) == (WORDS, 0, whole)
    r = first(suffixes.repeated(long))
    assert (r.n_bytes, r.n_removed, bytes(r.kept) if not isinstance(r.kept, str) else r.kept.encode()) == (len(whole), 0, whole.encode())
    r = first(jaccard.similar(long))
    assert (r.n_shingles, r.component_id) == (WORDS - 4, 1)
    rows = packing.pack(long).where("doc_id = 1").select("start", "length", "doc_tokens").orderBy("start").collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens > WORDS and all(a.start + a.length == b.start for a, b in zip(rows, rows[1:]))
    assert first(pieces.decode(pieces.encode(long, keep=["doc_id", "text"]), keep=["doc_id"]))["decoded"] == whole
    assert first(fim.transform(long).withColumn("back", fim.restored()))["back"] == whole
    assert first(secret_scan.scan(long))["spans"] == []


def test_models(long, docs, labels):
    few = docs.where("doc_id is not null")
    r = first(quality.judge(long, quality.fit(few, labels), keep=["doc_id"]))
    assert r.n_words == WORDS and r.kept is not None
    r = first(toxicity.score(long, toxicity.fit(few, labels), keep=["doc_id"]))
    assert 0 <= r.score <= 1


def test_stages_keep_a_clean_long_text(spark, long, tmp_path):
    toxic = [(10 + i, "vile hateful filth you idiot " * 8, "en", "s", 5) for i in range(12)]
    clean = [(50 + i, f"a calm page about gardens and rivers number {i} with many plain words in it, " * 3, "en", "s", 5) for i in range(12)]
    docs = long.unionByName(spark.createDataFrame(toxic + clean, long.schema))
    spark.createDataFrame([(r[0], 1, int(r[0] < 50)) for r in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == long.columns and docs.where("doc_id = 1").count() == 1
    assert first(docs)["text"] == first(long)["text"]
    pieces_of = corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id = 1"), str(tmp_path))
    assert pieces_of.agg(F.sum("length")).first()[0] > WORDS


def test_packing_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two", 5, 6, "x", 7)], "doc_id long, text string, start long, ids long, sequence_id string, `offset` long")
    r = packing.pack(df).collect()
    assert [(x.doc_id, x.start, x.sequence_id, x.offset) for x in r] == [(1, 0, 0, 0)]
