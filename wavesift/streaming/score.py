"""Windows that arrive as a stream, scored by a fitted model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.operators import pca
from wavesift.operators import outliers as rules


def outliers(features: DataFrame, model: pca.Components, mean: np.ndarray, root: np.ndarray, threshold: float) -> DataFrame:
    """Rows of a stream (or table) of features beyond a threshold fitted before; no state."""

    scored = pca.transform(features, model)
    far = rules.measured(scored, mean, root)
    return far.where(F.col("distance") > threshold)
