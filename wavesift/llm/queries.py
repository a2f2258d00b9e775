"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the line CRF's verdict of every document."""
    from wavesift.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op2_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    from wavesift.llm import urls

    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(pages), keep=["page_id"])


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    from wavesift.llm import pieces

    coded = pieces.encode(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    out = pieces.decode(coded, keep=["doc_id", "text", "ids", "n_ids", "n_byte_ids"])
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_ids", "n_byte_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth id."""
    from wavesift.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    from wavesift.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings removed from all documents."""
    from wavesift.llm import suffixes

    out = suffixes.repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows removed from all documents."""
    from wavesift.llm import substrings

    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", substrings.sha256_hex("kept").alias("kept_sha256"))


def op8_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    from wavesift.llm import layout

    return layout.extract(table(spark, sf_dir, "pages"), keep=["page_id"])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle Jaccard of 0.8 or more."""
    from wavesift.llm import jaccard

    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from wavesift.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, with the inertia and the centroid's digest."""
    from wavesift.llm import balls

    out = balls.clusters(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it."""
    from wavesift.llm import fim

    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, those of the base patterns and those found random."""
    from wavesift.llm import secret_scan

    base = secret_scan.KINDS[:3]
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(secret_scan.of_kinds("spans", [kind])).cast("long").alias(f"n_{kind}") for kind in base]
    return out.select("doc_id", *counts, F.sha2(secret_scan.as_text("spans", base), 256).alias("base_sha256"), secret_scan.as_text("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators with one right answer; models and searches have none."""
    return oracles.oracle_sql()
