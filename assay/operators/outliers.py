"""Outliers: IQR, z-score, Mahalanobis and isolation forest, scored in the plan, with source row indices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import RID, as_double, col, exact_quantiles

TREES, TREE_ROWS, FOREST_SEED = 100, 256, 42


def _flagged(df: DataFrame, columns: list[str], scores: list[Column]) -> DataFrame:
    """row_index, the columns, one flag a column, score: rows that any column flags (score above 0)."""
    safe = [F.coalesce(s, F.lit(0.0)) for s in scores]
    total = reduce(lambda a, b: F.greatest(a, b), safe) if len(safe) > 1 else safe[0]
    flags = F.array_compact(F.array(*[F.when(s > 0, F.lit(c)) for c, s in zip(columns, safe, strict=True)]))
    return df.select(F.col(RID).alias("row_index"), *[col(c) for c in columns], flags.alias("per_column_flags"), total.alias("score")).where("score > 0")


def iqr(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Beyond k IQRs from the quartiles; the score is the excess in IQRs. No spread, no outliers."""
    scores = []
    for c in columns:
        q1, q3 = exact_quantiles(df, c, [0.25, 0.75])
        if q1 is None or q3 == q1:
            scores.append(F.lit(0.0))
            continue
        x, width = as_double(col(c)), q3 - q1
        excess = F.greatest(F.lit(q1 - k * width) - x, x - F.lit(q3 + k * width))
        scores.append(F.when(excess > 0, excess / F.lit(width)).otherwise(0.0))
    return _flagged(df, columns, scores)


def zscore(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    stats = df.agg(*[f(as_double(col(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    scores = []
    for i, c in enumerate(columns):
        m, s = stats[f"m{i}"], stats[f"s{i}"]
        z = F.abs(as_double(col(c)) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        scores.append(F.when(z > k, z).otherwise(0.0))
    return _flagged(df, columns, scores)


def covariance(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sample covariance) of complete rows, one aggregate."""
    x = [as_double(col(c)) for c in columns]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in x])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    r = df.where(whole).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(x), len(x)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(len(x))]), cov


def quadratic(x: list[Column], matrix: np.ndarray) -> Column:
    """x' M x of a symmetric matrix, as an expression."""
    return reduce(lambda a, b: a + b, [F.lit(float(matrix[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))])


def mahalanobis(df: DataFrame, columns: list[str], alpha: float = 0.025, threshold: float | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """Squared distances beyond the chi-square cutoff (or ``threshold``); rows with a gap are left out."""
    n, mean, cov = covariance(df, columns)
    if n <= len(columns):
        raise ValueError("insufficient_rows")
    singular = np.linalg.matrix_rank(cov) < len(columns)
    inverse = np.linalg.pinv(cov) if singular else np.linalg.inv(cov)
    cutoff = threshold if threshold is not None else D.chi2_ppf(1 - alpha, len(columns))
    d2 = quadratic([as_double(col(c)) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)], inverse)
    out = df.select(F.col(RID).alias("row_index"), *[col(c) for c in columns], d2.alias("score")).where(F.col("score") > F.lit(cutoff))
    return out, {"cutoff": cutoff, "covariance_singular": bool(singular), "n_rows": n}


class Forest:
    """Isolation trees over one bounded sample, as arrays."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = FOREST_SEED):
        dice = np.random.RandomState(seed)
        self.rows = min(rows, len(sample))
        self.trees = [self._tree(sample[dice.permutation(len(sample))[: self.rows]], dice, 0, max(1, math.ceil(math.log2(max(2, self.rows))))) for _ in range(trees)]

    def _tree(self, x: np.ndarray, dice: np.random.RandomState, depth: int, most: int):
        spread = x.max(0) > x.min(0) if len(x) else np.zeros(x.shape[1], bool)
        if depth >= most or len(x) <= 1 or not spread.any():
            return depth + average_path(len(x))
        at = dice.choice(np.flatnonzero(spread))
        cut = dice.uniform(x[:, at].min(), x[:, at].max())
        left = x[:, at] <= cut
        return int(at), float(cut), self._tree(x[left], dice, depth + 1, most), self._tree(x[~left], dice, depth + 1, most)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): near 1 for isolated points."""
        total = np.zeros(len(x))
        for tree in self.trees:
            self._walk(tree, x, np.arange(len(x)), total)
        return np.exp2(-total / len(self.trees) / max(1e-9, average_path(self.rows)))

    def _walk(self, node, x: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        if not isinstance(node, tuple):
            total[rows] += node
            return
        left = x[rows, node[0]] <= node[1]
        self._walk(node[2], x, rows[left], total)
        self._walk(node[3], x, rows[~left], total)


def average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(df: DataFrame, columns: list[str], seed: int = FOREST_SEED) -> DataFrame:
    """row_index and anomaly score of complete rows; trees are grown on a bounded sample and broadcast."""
    x = [as_double(col(c)) for c in columns]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in x])
    own = df.where(whole).select(F.col(RID).alias("row_index"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    n = own.count()
    if n < max(10, 2 * len(columns)):
        raise ValueError("insufficient_rows")
    keep = 20 * TREE_ROWS
    sample = own.where(F.pmod(F.xxhash64("row_index"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, 1.5 * keep / n)))).orderBy(F.xxhash64("row_index")).limit(keep).toPandas()
    names = [f"x{i}" for i in range(len(columns))]
    forest = df.sparkSession.sparkContext.broadcast(Forest(sample[names].to_numpy(float), seed=seed))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row_index": b["row_index"], "score": forest.value.scores(b[names].to_numpy(float))})

    return own.mapInPandas(task, "row_index long, score double")


def isolation_forest(df: DataFrame, columns: list[str], contamination: float = 0.05) -> DataFrame:
    """The share ``contamination`` of rows with the highest scores."""
    scored = isolation_scores(df, columns)
    cut = exact_quantiles(scored, "score", [1 - contamination])[0]
    return df.select(F.col(RID).alias("row_index"), *[col(c) for c in columns]).join(scored.where(F.col("score") > F.lit(cut)), "row_index")


def top(found: DataFrame, limit: int = 50) -> DataFrame:
    return found.orderBy(F.desc("score"), "row_index").limit(limit)
