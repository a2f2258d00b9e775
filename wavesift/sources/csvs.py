"""CSV tables of labels, detections and trials with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELS = "start_sec double, file string, end_sec double"
TRIALS = "run_num int, n_components int, n_mels int, window_secs double, threshold_percentile double, distance_metric string, pca_method string, recall double, precision double, f1 double, n_outliers long, n_matched long, n_validation long, output_path string, note string"
INDEX = "source_path string, feature_path string, sr int, shape string"
OUTLIERS = "`Index` long, File string, `Start Frame` long, `Start Time (s)` double, Distance double, PC1 double, PC2 double"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write(df: DataFrame, path: str) -> None:
    """Always writes, also an empty table, so that no stale result stays."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Write the column ``line`` as text files, in the order of the rows."""
    df.select("line").write.mode("overwrite").text(path)
