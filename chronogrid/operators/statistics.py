"""Linear models over large tables: one pass adds up the Gram matrix, and only that, features x features, is solved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the columns, by sums over all rows without a null in any."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.select(*columns).dropna().agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"s{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((k, k))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[n] or 0.0
    return out


def ridge_fit(df: DataFrame, features: list[str], label: str, penalty: float = 1e-3) -> DataFrame:
    """(feature, beta) of (X'X + penalty)^-1 X'y; no intercept is added. Without a row all are 0."""
    g = gram(df, [*features, label])
    k = len(features)
    beta = np.linalg.solve(g[:k, :k] + penalty * np.eye(k), g[:k, k])
    return df.sparkSession.createDataFrame([(f, float(b)) for f, b in zip(features, beta, strict=True)], "feature string, beta double")


def vif_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, vif): the diagonal of (X'X)^-1; null where X'X has no inverse."""
    g = gram(df, features)
    full = np.linalg.matrix_rank(g) == len(features)
    values = np.diag(np.linalg.inv(g)) if full else [None] * len(features)
    return df.sparkSession.createDataFrame([(f, None if v is None else float(v)) for f, v in zip(features, values, strict=True)], "feature string, vif double")


def drop_high_vif(df: DataFrame, features: list[str], threshold: float = 10.0) -> DataFrame:
    """df without the features whose score reaches the threshold."""
    high = [r["feature"] for r in vif_scores(df, features).collect() if r["vif"] is not None and r["vif"] >= threshold]
    return df.drop(*high)


def condition_number(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: the greatest singular value of X over the least, that being 1e-12 at least."""
    values = np.sqrt(np.clip(np.linalg.eigvalsh(gram(df, features)), 0, None))
    return df.sparkSession.createDataFrame([(float(values.max() / max(values.min(), 1e-12)),)], "condition_number double")
