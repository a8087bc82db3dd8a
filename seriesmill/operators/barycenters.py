"""Barycentres of forecast paths: Euclidean, and under (soft) time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def euclidean(df: DataFrame, models: list[str]) -> DataFrame:
    """(unique_id, ds, barycenter): the members' mean at each step, as an expression."""
    total = sum((F.col(m) for m in models), F.lit(0.0))
    return df.select("unique_id", "ds", (total / len(models)).alias("barycenter"))


def _diagonals(n: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells (i, j) from (1, 1) to (n, m) whose sum is the same, in rising order; each needs only those before it."""
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        yield i, k - i


def path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone alignment of two series by squared differences; a diagonal of the table is filled at once."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i, j in _diagonals(n, m):
        cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + np.minimum(np.minimum(cost[i - 1, j - 1], cost[i - 1, j]), cost[i, j - 1])
    out, i, j = [], n, m
    while i and j:
        out.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda c: cost[c])
    return out[::-1]


def _start(series: list[np.ndarray]) -> np.ndarray:
    """The mean of the series stretched to the length of the first of the longest."""
    n = max(map(len, series))
    return np.mean([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(s)), s) if len(s) > 1 else np.full(n, s[0]) for s in series], axis=0)


def dtw(series: list[np.ndarray], weights: np.ndarray | None = None, max_iter: int = 5, tol: float = 1e-3) -> np.ndarray:
    """Averages of the values aligned with each step, until the weighted cost falls by less than ``tol``."""
    weights = np.ones(len(series)) / len(series) if weights is None else np.asarray(weights)
    mean, before = _start(series), np.inf
    for _ in range(max_iter):
        top, below, cost = np.zeros(len(mean)), np.zeros(len(mean)), 0.0
        for s, w in zip(series, weights, strict=True):
            i, j = np.array(path(mean, s)).T
            top += w * np.bincount(i, weights=s[j], minlength=len(mean))
            below += w * np.bincount(i, minlength=len(mean))
            cost += w * ((mean[i] - s[j]) ** 2).sum()
        mean = np.where(below > 0, top / np.where(below > 0, below, 1), mean)
        if abs(before - cost) < tol:
            break
        before = cost
    return mean


def dtw_subgradient(series: list[np.ndarray], weights: np.ndarray | None = None, max_iter: int = 5, tol: float = 1e-3, rate: float = 0.05) -> np.ndarray:
    """Steps against the subgradient of the weighted alignment cost."""
    weights = np.ones(len(series)) / len(series) if weights is None else np.asarray(weights)
    mean, before = _start(series), np.inf
    for _ in range(max_iter):
        slope, cost = np.zeros(len(mean)), 0.0
        for s, w in zip(series, weights, strict=True):
            i, j = np.array(path(mean, s)).T
            slope += 2 * w * np.bincount(i, weights=mean[i] - s[j], minlength=len(mean))
            cost += w * ((mean[i] - s[j]) ** 2).sum()
        mean = mean - rate * slope
        if abs(before - cost) < tol:
            break
        before = cost
    return mean


def soft_dtw(series: list[np.ndarray], weights: np.ndarray | None = None, gamma: float = 0.1, max_iter: int = 5, rate: float = 0.1) -> np.ndarray:
    """Gradient steps on the weighted soft alignment cost."""
    weights = np.ones(len(series)) / len(series) if weights is None else np.asarray(weights)
    mean = _start(series)
    for _ in range(max_iter):
        slope = sum(w * _soft_gradient(mean, s, gamma) for s, w in zip(series, weights, strict=True))
        mean = mean - rate * slope
    return mean


def _soft_gradient(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """The derivative by ``a``: expected alignments, forward and backward, times the slope of squared differences."""
    n, m = len(a), len(b)
    gap = (a[:, None] - b[None, :]) ** 2
    r = np.full((n + 2, m + 2), np.inf)
    r[0, 0] = 0
    for i, j in _diagonals(n, m):
        z = -np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
        top = z.max(axis=0)
        r[i, j] = gap[i - 1, j - 1] - gamma * (top + np.log(np.exp(z - top).sum(axis=0)))
    e, d = np.zeros((n + 2, m + 2)), np.zeros((n + 2, m + 2))
    d[1 : n + 1, 1 : m + 1] = gap
    e[n + 1, m + 1] = 1
    r[:, m + 1] = r[n + 1, :] = -np.inf
    r[n + 1, m + 1] = r[n, m]
    for i, j in reversed(list(_diagonals(n, m))):
        for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
            e[i, j] += e[x, y] * np.exp((r[x, y] - r[i, j] - d[x, y]) / gamma)
    return (2 * (a[:, None] - b[None, :]) * e[1 : n + 1, 1 : m + 1]).sum(axis=1)


KINDS = {"dtw": dtw, "dtw_subgradient": dtw_subgradient, "softdtw": soft_dtw}


def calc_average(df: DataFrame, models: list[str], barycenter: str = "euclidean") -> DataFrame:
    """(unique_id, ds, barycenter) of the members' paths in each series."""
    if barycenter == "euclidean":
        return euclidean(df, models)
    if barycenter not in KINDS:
        raise ValueError(f"unknown barycentre {barycenter!r}")
    make = KINDS[barycenter]

    def run(pdf):
        pdf = pdf.sort_values("ds")
        return pdf[["unique_id", "ds"]].assign(barycenter=make([pdf[m].to_numpy(dtype=float) for m in models]))

    return df.select("unique_id", "ds", *models).groupBy("unique_id").applyInPandas(run, f"unique_id string, ds {dict(df.dtypes)['ds']}, barycenter double")
