"""What the embedding operators share: valid vectors, bounded training samples, k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000


def is_valid(col: str) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    x = F.col(col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, *more: str | Column, every: bool = False) -> DataFrame:
    """id, v and more of the rows with a valid vector; of every row, with a null v for the others, if asked for.

    Components stay float or double as they are; other numbers become double.
    """
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")
    if every:
        return df.select(F.col(id_col).alias("id"), F.when(is_valid(vector_col), v).alias("v"), *more)
    return df.where(is_valid(vector_col)).select(F.col(id_col).alias("id"), v.alias("v"), *more)


def matrix(column) -> np.ndarray:
    """A pandas or Arrow column of equally long vectors as float64 rows."""
    return np.array(list(column), np.float64)


def sample(vectors: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Up to `rows` distinct vectors, the same for the same table: a bounded training sample."""
    h = F.xxhash64("v")
    n = vectors.agg(F.approx_count_distinct(h)).first()[0] or 1
    parts = 1 << 30
    likely = vectors.where(F.pmod(h, F.lit(parts)) < int(min(1.0, 1.5 * rows / n) * parts)).select("v").distinct()
    return matrix(sorted(map(tuple, likely.orderBy(F.xxhash64("v")).limit(rows).toPandas()["v"])))


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first."""
    d = (centres**2).sum(1) - 2 * x @ centres.T
    if k == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centres; a centre without rows keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([nearest(x[i : i + 4096], centres)[:, 0] for i in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres
