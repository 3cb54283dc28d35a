"""Variance inflation from one Gram-matrix aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from freightlens.functions.products import cross_products
from freightlens.functions.scalars import snap


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Row count and X'X over rows where every column is present."""
    full = cross_products(df.select(*columns).dropna(), [F.lit(1.0), *[F.col(c) for c in columns]])
    return int(full[0, 0]), full[1:, 1:]


def vif_values(matrix: np.ndarray) -> np.ndarray:
    """Uncentred VIF: diag(G) * diag(inv(G)); a column that the others reproduce exactly gets infinity."""
    scale = np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
    normal = matrix / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(normal)
    tiny = values < 1e-12 * max(values.max(), 1e-300)
    out = ((vectors[:, ~tiny] ** 2) / values[~tiny]).sum(axis=1)
    out[(np.abs(vectors[:, tiny]) > 1e-6).any(axis=1)] = np.inf
    return out


def vif_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """VIF of each column given the others, highest first."""
    n, matrix = gram(df, columns)
    rows = [(c, float(v), int(n)) for c, v in zip(columns, vif_values(matrix))]
    out = df.sparkSession.createDataFrame(rows, "feature string, vif double, n_rows bigint")
    return out.withColumn("vif", snap("vif")).orderBy(F.desc("vif"), "feature")


def fit_vif_filter(df: DataFrame, columns: list[str], threshold: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop the worst column until all are at or below the threshold; returns (kept, [(dropped, vif)]).

    The matrix is aggregated once; it is taken again only when a dropped column had missing
    cells, because the set of complete rows then grows.
    """
    nullable = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    keep, dropped, matrix, n = list(columns), [], None, 0
    while len(keep) >= 2:
        if matrix is None:
            n, matrix = gram(df, keep)
        if n < len(keep) + 1:
            break
        values = vif_values(matrix)
        worst = int(np.argmax(values))
        if values[worst] <= threshold:
            break
        name = keep.pop(worst)
        dropped.append((name, float(values[worst])))
        matrix = None if nullable[name] else np.delete(np.delete(matrix, worst, 0), worst, 1)
    return keep, dropped


def vif_filter(df: DataFrame, columns: list[str], threshold: float = 10.0) -> DataFrame:
    """`df` without the collinear columns; everything outside `columns` is kept."""
    _, dropped = fit_vif_filter(df, columns, threshold)
    return df.drop(*[name for name, _ in dropped])
