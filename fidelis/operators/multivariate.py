"""Multivariate screens: Mahalanobis outliers, VIF, first principal component.

One moment pass over the rows, then the p x p algebra of each dataset in its own group
(``applyInPandas`` on p x p rows); what it returns is joined back to the rows as a broadcast
table of one row per dataset, so the plan does not grow with the datasets and no task holds one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.stats import chi2_quantile_wh
from fidelis.operators.dependency import moments

DATASET = ["technique", "replicate"]


def _matrix(group: pd.DataFrame, items: list[str], corr: bool) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance (or correlation) matrix from a dataset's moment rows."""
    at = {v: i for i, v in enumerate(items)}
    mean, m = np.zeros(len(items)), np.eye(len(items))
    for r in group.itertuples():
        i, j = at[r.var_i], at[r.var_j]
        mean[i], mean[j] = r.mean_i, r.mean_j
        m[i, j] = m[j, i] = r.corr if corr else r.cov
        if not corr:
            m[i, i], m[j, j] = r.sd_i**2, r.sd_j**2
    return mean, m


def _per_dataset(df: DataFrame, items: list[str], by: list[str], fields: str, solve: Callable, corr: bool) -> DataFrame:
    """``solve(mean, matrix)`` -> list of rows, per dataset; datasets with a missing moment give no row."""
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + f", {fields}"
    names = [*by, *[f.split()[0] for f in fields.split(", ")]]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mean, m = _matrix(group, items, corr)
        rows = [(*[group[b].iloc[0] for b in by], *r) for r in solve(mean, m)] if np.isfinite(m).all() else []
        return pd.DataFrame(rows, columns=names)

    return moments(df, items, by).groupBy(*by).applyInPandas(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mahalanobis_outliers(df: DataFrame, items: Sequence[str], by=DATASET, level: float = 0.999) -> DataFrame:
    """Adds ``mahalanobis`` and ``keep`` (distance < sqrt(chi2_level(p))), per dataset."""
    items, by = list(items), list(by)
    cut = float(np.sqrt(chi2_quantile_wh(level, len(items))))

    def solve(mean: np.ndarray, m: np.ndarray) -> list[tuple]:
        # rows of a root of the inverse: the distance is the length of root . (x - mean)
        w, v = np.linalg.eigh(np.linalg.pinv(m))
        root = (v * np.sqrt(np.maximum(w, 0))).T
        return [(mean.tolist(), root.tolist())]

    params = _per_dataset(df, items, by, "_mean array<double>, _root array<array<double>>", solve, False)
    x = F.zip_with(F.array(*[F.col(i).cast("double") for i in items]), F.col("_mean"), lambda a, b: a - b)
    # one row per dataset: the rows are not shuffled by dataset, which would give a task all of REAL
    out = df.join(F.broadcast(params), by, "left").withColumn("_x", x)
    square = F.aggregate("_root", F.lit(0.0), lambda s, row: s + _dot(row, F.col("_x")) * _dot(row, F.col("_x")))
    return out.withColumn("mahalanobis", F.sqrt(square)).withColumn("keep", F.col("mahalanobis") < F.lit(cut)).drop("_mean", "_root", "_x")


def vif(df: DataFrame, items: Sequence[str], by=DATASET) -> DataFrame:
    """Variance inflation factor per item = diagonal of the inverse correlation matrix."""
    items = list(items)
    return _per_dataset(df, items, list(by), "variable string, vif double",
                        lambda _, r: list(zip(items, np.diag(np.linalg.pinv(r)).tolist(), strict=True)), True)


def pca_first_component(df: DataFrame, items: Sequence[str], by=DATASET, min_share: float = 0.15) -> DataFrame:
    """PC1 of the standardised items per dataset: explained share, acceptance (> 0.15) and loadings."""
    items = list(items)

    def solve(_, r: np.ndarray) -> list[tuple]:
        w, v = np.linalg.eigh(r)
        vec = v[:, -1] * (1 if v[:, -1].sum() >= 0 else -1)
        share = float(w[-1] / w.sum())
        return [(it, float(x), share, share > min_share) for it, x in zip(items, vec, strict=True)]

    return _per_dataset(df, items, list(by), "variable string, loading double, explained_share double, accepted boolean", solve, True)


def pca_scores(df: DataFrame, items: Sequence[str], by=DATASET) -> DataFrame:
    """Adds ``pc1``, the row's score on its dataset's first component of the standardised items."""
    items, by = list(items), list(by)
    loadings = pca_first_component(df, items, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("variable", "loading"))).alias("_load"))
    stats = df.groupBy(*by).agg(*[F.avg(i).alias(f"_m_{i}") for i in items], *[F.stddev_samp(i).alias(f"_s_{i}") for i in items])
    terms = [(F.col(i) - F.col(f"_m_{i}")) / F.col(f"_s_{i}") * F.col("_load")[i] for i in items]
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    return df.join(F.broadcast(stats), by).join(F.broadcast(loadings), by, "left").select(*df.columns, score.alias("pc1"))
