"""Folders of files on any store that Arrow reaches, by one path or URI."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and its path there; a plain path is on a disk that all executors mount."""
    root = re.sub(r"^file:/+", "/", root)
    store, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    return store, path.rstrip("/")


def listed(root: str, suffix: str) -> list[tuple[str, int]]:
    """Path below the folder and size of all its files with a suffix, sorted; a missing folder is an error."""
    store, path = opened(root)
    if store.get_file_info(path).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder at {root}")
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path[len(path) + 1 :], f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach; one of its own where Spark is local and it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, for files that go when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def below(path: Column, root: str) -> Column:
    """The part of a path below the root, whatever scheme it is written with."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.substring(path, F.instr(path, plain) + len(plain), F.length(path))
