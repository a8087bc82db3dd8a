"""Generators that need numerical routines on whole series: time warping, block bootstrap, barycentres and kernels."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators import barycenters
from seriesmill.operators.synth import Generator, numbered, spline_basis
from seriesmill.panel import DEFAULT, Names


def generator_of(seed: int, *keys) -> np.random.Generator:
    """A generator that depends on the seed and the keys alone."""
    digest = hashlib.blake2b("|".join(map(str, (seed, *keys))).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def spline(position: np.ndarray, knots: np.ndarray) -> np.ndarray:
    second = spline_basis(len(knots)) @ knots
    i = np.minimum(position.astype(int), len(knots) - 2)
    t = position - i
    u = 1 - t
    return u * knots[i] + t * knots[i + 1] + ((u**3 - u) * second[i] + (t**3 - t) * second[i + 1]) / 6


class _BySeries(Generator):
    """One function of a series' values at a time, in parallel over series."""

    def _values(self, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def _make(self, df: DataFrame) -> DataFrame:
        uid, ds, y = self.names.id, self.names.time, self.names.target

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ds).copy()
            pdf[y] = self._values(pdf[y].to_numpy(dtype=float), generator_of(self.seed, self.alias, pdf[uid].iloc[0]))
            return pdf[[uid, ds, y]]

        kinds = dict(df.dtypes)
        return df.select(uid, ds, y).groupBy(uid).applyInPandas(run, f"`{uid}` string, `{ds}` {kinds[ds]}, `{y}` double")


class TimeWarping(_BySeries):
    """The series read at smoothly distorted times; outside the distorted span its ends go on.

    The distortion may run backwards; ``monotone`` keeps it from doing so.
    """

    alias = "TIM"

    def __init__(self, sigma: float = 0.2, knot: int = 4, monotone: bool = False, **kw):
        super().__init__(**kw)
        self.sigma, self.knot, self.monotone = sigma, knot, monotone

    def _values(self, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(y)
        if n < 2:
            return y
        steps = np.arange(n)
        knots = np.linspace(0, n - 1, self.knot + 2) * rng.normal(1, self.sigma, self.knot + 2)
        warp = spline(steps * (self.knot + 1) / (n - 1), knots)
        return np.interp(steps, np.maximum.accumulate(warp) if self.monotone else warp, y)


def local_line(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Tricube-weighted lines through the ``width`` nearest points, read at ``at``."""
    weights = np.ones(len(x)) if weights is None else weights
    distance = np.abs(at[:, None] - x[None, :])
    near = np.partition(distance, min(width, len(x)) - 1, axis=1)[:, min(width, len(x)) - 1] * max(1.0, width / len(x))
    w = np.clip(1 - (distance / np.maximum(near, 1e-12)[:, None]) ** 3, 0, None) ** 3 * weights
    w += 1e-12
    s = w.sum(axis=1)
    mx, my = (w @ x) / s, (w @ y) / s
    dx = x[None, :] - mx[:, None]
    slope = (w * dx * (y[None, :] - my[:, None])).sum(axis=1) / np.maximum((w * dx * dx).sum(axis=1), 1e-12)
    return my + slope * (at - mx)


def stl(y: np.ndarray, period: int, rounds: int = 2, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and rest of a series by local lines; it needs two periods."""
    n = len(y)
    if n < 2 * period or period < 2:
        raise ValueError("a decomposition needs two periods")
    steps = np.arange(n, dtype=float)
    width = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    trend = np.zeros(n)
    for _ in range(rounds):
        flat, cycle = y - trend, np.zeros(n + 2 * period)
        for p in range(period):
            part = flat[p::period]
            at = np.arange(-1, len(part) + 1, dtype=float)
            smooth = local_line(np.arange(len(part), dtype=float), part, at, seasonal)
            cycle[p::period][: len(smooth)] = smooth
        box = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
        low = local_line(steps, box(box(box(cycle, period), period), 3), steps, period | 1)
        season = cycle[period : period + n] - low
        trend = local_line(steps, y - season, steps, width)
    return trend, season, y - season - trend


class SeasonalMBB(_BySeries):
    """Trend and season with residuals resampled in blocks of a period, on the signed log scale.

    ``max_samples`` cuts long series into chunks, a short last one joined to the
    one before. Too short for a decomposition, residuals about the mean are
    drawn one by one; a single value stays as it is.
    """

    alias = "MBB"

    def __init__(self, seas_period: int, log: bool = True, max_samples: int | None = None, **kw):
        super().__init__(**kw)
        self.period, self.log, self.max_samples = seas_period, log, max_samples

    def chunks(self, n: int) -> list[slice]:
        c = self.max_samples
        if not c or n <= c:
            return [slice(0, n)]
        edges = [*range(0, n, c), n]
        if n % c:
            del edges[-2]
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def _chunk(self, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n, b = len(y), self.period
        try:
            trend, season, rest = stl(y, b)
        except ValueError:
            return y.mean() + rng.choice(y - y.mean(), n) if n > 1 else y
        starts = rng.integers(0, n - b + 1, n // b + 2)
        drawn = np.concatenate([rest[s : s + b] for s in starts])
        first = rng.integers(0, b)
        return trend + season + drawn[first : first + n]

    def _values(self, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        z = np.sign(y) * np.log1p(np.abs(y)) if self.log else y
        z = np.concatenate([self._chunk(z[s], rng) for s in self.chunks(len(z))]) if len(z) else z
        return np.sign(z) * np.expm1(np.abs(z)) if self.log else z


class DBA(Generator):
    """Weighted barycentres under time warping of up to ``max_n_uids`` series drawn with replacement."""

    def __init__(self, max_n_uids: int, dirichlet_alpha: float = 1.0, max_iter: int = 10, tol: float = 1e-3, seed: int = 0, names: Names = DEFAULT):
        super().__init__(seed, False, names)
        self.max_uids, self.alpha, self.max_iter, self.tol = max_n_uids, dirichlet_alpha, max_iter, tol

    def transform(self, df: DataFrame, n_series: int = -1) -> DataFrame:
        from seriesmill.functions import rng

        uid, ds, y = self.names.id, self.names.time, self.names.target
        order = F.array_sort(F.collect_list(F.struct(F.col(ds).alias("t"), F.col(y).cast("double").alias("v"))))
        listed = numbered(df.select(uid).distinct(), uid, "number")
        count = listed.agg(F.count(F.lit(1)).alias("uids"))
        outs = df.sparkSession.range(n_series) if n_series >= 0 else listed.select(F.col("number").cast("long").alias("id"))
        draws = outs.crossJoin(F.broadcast(count)).withColumn("k", rng.randint(self.seed, "k", F.lit(1), F.lit(self.max_uids), F.col("id")))
        draws = draws.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k"))))
        draws = draws.select("id", F.floor(rng.uniform(self.seed, "uid", F.col("id"), F.col("j")) * F.col("uids")).cast("long").alias("number")).distinct().join(listed, "number")
        series = df.groupBy(uid).agg(order.alias("rows")).select(uid, F.transform("rows", lambda r: r.t).alias("t"), F.transform("rows", lambda r: r.v).alias("v"))
        kind = dict(df.dtypes)[ds]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(uid)
            n = int(pdf["id"].iloc[0])
            weights = generator_of(self.seed, "dba", n).dirichlet([self.alpha] * len(pdf))
            values = [np.asarray(v, dtype=float) for v in pdf["v"]]
            mean = barycenters.dtw(values, weights, self.max_iter, self.tol)
            longest = max(range(len(pdf)), key=lambda i: len(values[i]))
            return pd.DataFrame({uid: f"DBA_{n}", ds: list(pdf["t"].iloc[longest])[: len(mean)], y: mean})

        return draws.join(series, uid).groupBy("id").applyInPandas(run, f"`{uid}` string, `{ds}` {kind}, `{y}` double")


#: Periods, widths and levels of the kernel bank.
PERIODS = (24, 48, 96, 24 * 7, 48 * 7, 96 * 7, 7, 14, 30, 60, 365, 730, 4, 26, 52, 4, 6, 12, 4, 40, 10)
SIGMAS, SCALES, MIXES, NOISES = (0.0, 1.0, 10.0), (0.1, 1.0, 10.0), (0.1, 1.0, 10.0), (0.1, 1.0)


def kernel_bank() -> list:
    """Covariances over two columns of times: periodic, linear, squared exponential, rational quadratic, noise and constant."""
    gap = lambda a, b: np.abs(a[:, None] - b[None, :])
    bank = [lambda a, b, p=p / 1024: np.exp(-2 * np.sin(np.pi * gap(a, b) / p) ** 2) for p in PERIODS]
    bank += [lambda a, b, s=s: s * s + a[:, None] * b[None, :] for s in SIGMAS]
    bank += [lambda a, b, s=s: np.exp(-(gap(a, b) ** 2) / (2 * s * s)) for s in SCALES]
    bank += [lambda a, b, m=m: (1 + gap(a, b) ** 2 / (2 * m)) ** -m for m in MIXES]
    bank += [lambda a, b, v=v: v * (gap(a, b) == 0) for v in NOISES]
    return [*bank, lambda a, b: np.ones((len(a), len(b)))]


class KernelSynth:
    """Draws of zero-mean Gaussian processes whose kernels are random sums and products from the bank."""

    def __init__(self, max_kernels: int, n_obs: int, freq: str = "MS", seed: int = 0, names: Names = DEFAULT):
        self.max_kernels, self.n_obs, self.freq, self.seed, self.names = max_kernels, n_obs, freq, seed, names

    def sample(self, number: int) -> np.ndarray:
        rng, t, bank = generator_of(self.seed, "kernel", number), np.linspace(0, 1, self.n_obs), kernel_bank()
        cov = None
        for i in rng.integers(0, len(bank), rng.integers(1, self.max_kernels + 1)):
            k = bank[i](t, t)
            cov = k if cov is None else cov + k if rng.integers(2) else cov * k
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        return vectors @ (np.sqrt(np.clip(values, 0, None)) * rng.normal(size=self.n_obs))

    def transform(self, spark: SparkSession, n_series: int) -> DataFrame:
        uid, ds, y = self.names.id, self.names.time, self.names.target
        times = list(pd.date_range("2000-01-01", periods=self.n_obs, freq=self.freq))

        def run(batches):
            for pdf in batches:
                for n in pdf["id"]:
                    yield pd.DataFrame({uid: f"KS_UID{n}", ds: times, y: self.sample(int(n))})

        return spark.range(n_series).mapInPandas(run, f"`{uid}` string, `{ds}` timestamp_ntz, `{y}` double")
