"""Import of spectrogram archives (``.npz``) into the frames table."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, root: str, n_bins: int | None = None, key: str = "feature", recursive: bool = True) -> DataFrame:
    """file, frame, bins of all archives below root, by path where one looks at files; see ``decoded``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.npz").load(root).select("path", "content")
    return decoded(files, n_bins, key)


def decoded(files: DataFrame, n_bins: int | None = None, key: str = "feature") -> DataFrame:
    """file, frame, bins of archives (path, content); unreadable ones give one row with error.

    An array is squeezed to two axes and turned if its second axis has ``n_bins``. Null
    content can't be read.
    """

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content)) as archive:
                        if key not in archive:
                            raise KeyError(key)
                        s = np.squeeze(archive[key]).astype(np.float32)
                    if s.ndim != 2:
                        raise ValueError(f"{s.ndim} axes")
                    if n_bins is not None and s.shape[0] != n_bins:
                        if s.shape[1] != n_bins:
                            raise ValueError(f"no axis of {n_bins} bins")
                        s = s.T
                except Exception as e:
                    yield pd.DataFrame({"file": [path], "frame": [None], "bins": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                for at in range(0, s.shape[1], 2048):
                    part = s[:, at : at + 2048].T
                    yield pd.DataFrame({"file": path, "frame": np.arange(at, at + len(part)), "bins": list(part.astype(np.float64)), "error": None})

    return files.mapInPandas(run, "file string, frame long, bins array<double>, error string")
