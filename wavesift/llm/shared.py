"""Tables written to the folder all executors share, to cut lineage between passes."""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it is unset and Spark is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL


def _place(spark: SparkSession, path: str):
    """File system and path object of Hadoop, which reach every store that Spark reads."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, where = _place(spark, path)
    store.deleteOnExit(where)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*things: DataFrame | Broadcast) -> None:
    """Remove written tables and broadcasts that nothing reads any more."""
    for thing in things:
        if isinstance(thing, Broadcast):
            thing.destroy()
        else:
            store, where = _place(thing.sparkSession, thing.written_at)
            store.delete(where, True)
