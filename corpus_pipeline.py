"""A training-data pipeline in five stages, each one operator on what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of their input, whatever those are besides doc_id and text. Columns with the
names that an operator adds keep their values. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import jaccard, packing, quality, suffixes, toxicity
from wavesift.llm.rows import guarded
from wavesift.llm.shared import dropped, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment search calls toxic go.

    A null or empty text has no passage and stays; a score on the threshold is toxic;
    repeated rows are judged alike, also with a null doc_id.
    """
    inner, names, back = guarded(docs, ["doc_id", "text"])
    model = toxicity.fit(inner, _labels(spark, sf_dir))
    return back(toxicity.score(inner, model, keep=names).where("predicted = 0"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go.

    A null or empty text has too few words and goes; a content share of just one half
    stays; repeated rows are judged alike.
    """
    inner, names, back = guarded(docs, ["doc_id", "text"])
    model = quality.fit(inner, _labels(spark, sf_dir))
    return back(quality.judge(inner, model, keep=names).where("kept"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Texts without words (null, empty, white space) are linked with nothing and all stay. Of
    rows that share the least id one stays; a null id comes after all others.
    """
    inner, names, back = guarded(docs, ["doc_id", "text"])
    return back(jaccard.similar(inner, keep=names).where("is_representative"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur again go from the texts; n_chars follows.

    A null text becomes an empty one, a text that is gone altogether too: no row is
    dropped. Of repeated rows of 200 bytes or more all lose their text. Parts of a
    character that a cut leaves behind go as well.
    """
    plain = ["doc_id", "text", "n_chars"]
    inner, names, back = guarded(docs, plain)
    out = suffixes.repeated(inner, keep=names, as_text=True).withColumn("text", F.col("kept"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token run in sequences of 2048 ids, with their ids.

    A null or empty text is its end id alone; repeated rows are packed once each.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("suffixes", suffix_stage),
    ("packing", packing_stage),
]

#: The models and the segment search are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if nth:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
