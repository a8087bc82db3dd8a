"""Series generators as column expressions: jittering, scaling, magnitude warping and mixing."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions import rng
from seriesmill.panel import DEFAULT, Names
from seriesmill.shared import shared_dir

RANGE = 1 << 20  # ids that one task puts in order


def _target(df: DataFrame, value: Column, names: Names, integer_output: bool | None) -> Column:
    """Integers stay integers, by truncation."""
    kind = dict(df.dtypes)[names.target]
    whole = kind in ("int", "bigint", "smallint", "tinyint") if integer_output is None else integer_output
    return value.cast(kind if kind not in ("double", "float") else "bigint") if whole else value


def numbered(ids: DataFrame, key: str, number: str, count: int | None = None) -> DataFrame:
    """``ids``, one row a ``key``, with ``number``: the rows before it in the order of keys.

    Up to RANGE of ``count`` rows are put in order by one task. More are dealt
    to ranges of keys, written to the shared folder and numbered within their
    range from the rows of the ranges before it, so no task sees them all.
    """
    count = ids.count() if count is None else count
    if count <= RANGE:
        return ids.withColumn(number, F.row_number().over(W.orderBy(key)) - 1)
    path = f"{shared_dir(ids.sparkSession)}/ids-{uuid.uuid4().hex}"
    ids.repartitionByRange(-(-count // RANGE) + 1, key).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = ids.sparkSession.read.parquet(path)
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy("__range")) - F.col("__size")  # a row a range
    within = F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1
    bases = F.broadcast(sizes.select("__range", before.alias("__base")))
    return dealt.withColumn(number, within).join(bases, "__range").withColumn(number, F.col("__base") + F.col(number)).select(*ids.columns, number)


def renamed(df: DataFrame, alias: str, names: Names = DEFAULT, offset: int = 0, count: int | None = None) -> DataFrame:
    """Ids become id_alias and a number by the order of ids, from ``offset``; ``count`` is the number of distinct ids, if known."""
    numbers = numbered(df.select(names.id).distinct(), names.id, "__n", count).withColumn("__n", F.col("__n") + offset)
    new = F.concat(F.col(names.id), F.lit(f"_{alias}"), F.col("__n").cast("string"))
    return df.join(numbers, names.id).withColumn(names.id, new).drop("__n").select(df.columns)


class Generator:
    """Makes one new series of each; ``rename_uids`` numbers on from call to call."""

    alias = "SYN"

    def __init__(self, seed: int = 0, rename_uids: bool = True, names: Names = DEFAULT):
        self.seed, self.rename, self.names, self.counter = seed, rename_uids, names, 0

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._make(df)
        if not self.rename:
            return out
        count = df.select(self.names.id).distinct().count()
        named = renamed(out, self.alias, self.names, self.counter, count)
        self.counter += count
        return named

    def augment(self, df: DataFrame) -> DataFrame:
        return df.unionByName(self.transform(df).select(df.columns))

    def _key(self) -> tuple[Column, Column]:
        return F.col(self.names.id), F.col(self.names.time)

    def _make(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Jittering(Generator):
    """y + N(0, sigma * std of the series), anew for each point; a series of one row gets null."""

    alias = "JIT"

    def __init__(self, sigma: float = 0.03, **kw):
        super().__init__(**kw)
        self.sigma = sigma

    def _make(self, df: DataFrame) -> DataFrame:
        y = F.col(self.names.target)
        spread = F.stddev_samp(y).over(W.partitionBy(self.names.id))
        return df.withColumn(self.names.target, _target(df, y + rng.normal(self.seed, "jitter", *self._key()) * self.sigma * spread, self.names, None))


class Scaling(Generator):
    """y * N(1, sigma), anew for each point or, with ``per`` 'series', once a series."""

    alias = "SCA"

    def __init__(self, sigma: float = 0.1, per: str = "point", **kw):
        super().__init__(**kw)
        self.sigma, self.per = sigma, per

    def _make(self, df: DataFrame) -> DataFrame:
        key = self._key() if self.per == "point" else self._key()[:1]
        return df.withColumn(self.names.target, _target(df, F.col(self.names.target) * (1 + self.sigma * rng.normal(self.seed, "scale", *key)), self.names, None))


@lru_cache(maxsize=None)
def spline_basis(knots: int) -> np.ndarray:
    """Second derivatives, by knot value, of the not-a-knot cubic spline through equispaced knots at 0..knots-1."""
    n = knots
    if n < 4:
        raise ValueError("a not-a-knot spline needs four knots")
    a, rhs = np.zeros((n, n)), np.zeros((n, n))
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)  # equal third derivatives across the second and the last but one knot
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        rhs[i, i - 1 : i + 2] = 6, -12, 6
    return np.linalg.solve(a, rhs)


def spline_value(position: Column, knots: list[Column]) -> Column:
    """The spline through ``knots`` at ``position`` in [0, len(knots) - 1], as one expression."""
    n = len(knots)
    values = F.array(*knots)
    second = F.array(*[sum((F.lit(float(w)) * k for w, k in zip(row, knots, strict=True)), F.lit(0.0)) for row in spline_basis(n)])
    i = F.least(F.floor(position), F.lit(n - 2)).cast("int")
    t, u = position - i, 1 - (position - i)
    at = lambda column, j: F.element_at(column, j + 1)
    return u * at(values, i) + t * at(values, i + 1) + ((u * u * u - u) * at(second, i) + (t * t * t - t) * at(second, i + 1)) / 6


class MagnitudeWarping(Generator):
    """y times a smooth curve through ``knot`` + 2 draws of N(1, sigma), equispaced over the series."""

    alias = "MAG"

    def __init__(self, sigma: float = 0.2, knot: int = 4, **kw):
        super().__init__(**kw)
        self.sigma, self.knot = sigma, knot

    def _make(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.names.id)
        rank, n = F.row_number().over(w.orderBy(self.names.time)) - 1, F.count(F.lit(1)).over(w)
        last = self.knot + 1
        knots = [1 + self.sigma * rng.normal(self.seed, f"knot{j}", F.col(self.names.id)) for j in range(self.knot + 2)]
        placed = df.withColumns({"__p": F.when(n > 1, rank * F.lit(float(last)) / (n - 1)).otherwise(F.lit(0.0)), **{f"__k{j}": k for j, k in enumerate(knots)}})
        curve = spline_value(F.col("__p"), [F.col(f"__k{j}") for j in range(self.knot + 2)])
        return placed.withColumn(self.names.target, _target(df, F.col(self.names.target) * curve, self.names, None)).select(df.columns)


class TSMixup(Generator):
    """Weighted sums of random parts of up to ``max_n_uids`` series.

    Each output draws its number of series, those series with replacement
    (repeats collapse), a length by the shortest of them and the limits, a start
    in each, and Dirichlet weights: Gamma draws of any positive ``alpha``, over
    their sum.
    Timestamps are the first of the first series drawn. All draws are a table
    keyed by the output's number, joined to the rows by series.
    """

    def __init__(self, max_n_uids: int, min_len: int, max_len: int, dirichlet_alpha: float = 1.5, seed: int = 0, names: Names = DEFAULT):
        super().__init__(seed, False, names)
        self.max_uids, self.min_len, self.max_len, self.alpha = max_n_uids, min_len, max_len, dirichlet_alpha

    def transform(self, df: DataFrame, n_series: int = -1) -> DataFrame:
        uid, ds, y = self.names.id, self.names.time, self.names.target
        sizes = df.groupBy(uid).agg(F.count(F.lit(1)).alias("n"))
        listed = numbered(sizes, uid, "number")
        count = sizes.agg(F.count(F.lit(1)).alias("uids"))
        spark = df.sparkSession
        outs = spark.range(n_series) if n_series >= 0 else listed.select(F.col("number").cast("long").alias("id"))
        seed = self.seed
        draws = outs.crossJoin(F.broadcast(count)).withColumn("k", rng.randint(seed, "k", F.lit(1), F.lit(self.max_uids), F.col("id")))
        draws = draws.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("number", F.floor(rng.uniform(seed, "uid", F.col("id"), F.col("j")) * F.col("uids")).cast("long"))
        draws = draws.groupBy("id", "number").agg(F.min("j").alias("j")).join(listed, "number")
        gamma = rng.gamma(seed, "gamma", self.alpha, F.col("id"), F.col("j"))
        each = W.partitionBy("id")
        most = lambda limit: F.least(F.min("n").over(each), F.lit(limit))
        length = F.when(F.lit(self.min_len == self.max_len), most(self.min_len)).when(most(self.max_len) < most(self.min_len), most(self.max_len)).otherwise(rng.randint(seed, "len", most(self.min_len), most(self.max_len), F.col("id")))
        picked = draws.withColumns({"gamma": gamma, "length": length, "first": F.min("j").over(each) == F.col("j")})
        picked = picked.withColumns({"weight": F.col("gamma") / F.sum("gamma").over(each), "start": rng.randint(seed, "start", F.lit(0), F.col("n") - F.col("length"), F.col("id"), F.col("j"))})
        ranked = df.select(uid, ds, y, (F.row_number().over(W.partitionBy(uid).orderBy(ds)) - 1).alias("at"))
        rows = picked.join(ranked, uid)
        parts = rows.where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("length")))
        mixed = parts.groupBy("id", (F.col("at") - F.col("start")).alias("step")).agg(F.sum(F.col("weight") * F.col(y)).alias(y))
        times = rows.where(F.col("first") & (F.col("at") < F.col("length"))).select("id", F.col("at").alias("step"), ds)
        return times.join(mixed, ["id", "step"]).select(F.concat(F.lit("TSMixup_"), F.col("id").cast("string")).alias(uid), ds, y)
