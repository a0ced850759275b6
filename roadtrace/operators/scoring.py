"""Batch scoring with a model that each worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict(df: DataFrame, features: list[str], load: Callable[[], Callable], out: str = "prediction") -> DataFrame:
    """Add ``load()(frame of features)`` as a double; NULL where a feature is missing."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in parts:
            ok = frame.notna().all(axis=1)
            y = pd.Series(float("nan"), index=frame.index, dtype="float64")
            if ok.any():
                y[ok] = model(frame[ok])
            yield y

    scored = df.withColumn(out, score(F.struct(*features)))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def linear_model(weights: list[float], intercept: float = 0.0) -> Callable:
    """A loader of a linear model, for tests and baselines."""

    def load():
        return lambda frame: frame.to_numpy(float) @ weights + intercept

    return load
