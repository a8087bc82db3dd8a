"""Long-horizon correction of forecast paths by nearest trajectories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions import metrics
from seriesmill.functions.transforms import ewm, reach
from seriesmill.panel import member_names

FOLD = 256  # values that a window of the smoothed mean folds at most


def smooth(df: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Replaces y by its exponentially weighted mean.

    A fold over the values whose weights count in double precision, so that work
    grows with a series' length and not its square; where those are many
    (``alpha`` below 0.2), one pass over the series in Arrow instead.
    """
    if reach(alpha) <= FOLD:
        w = W.partitionBy("unique_id").orderBy("ds").rowsBetween(-reach(alpha), W.currentRow)
        return df.withColumn("y", ewm(F.collect_list("y").over(w), alpha))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        return pdf.assign(y=pdf["y"].astype(float).ewm(alpha=alpha, adjust=True, ignore_na=True).mean())

    out = df.withColumn("y", F.col("y").cast("double"))
    return out.groupBy("unique_id").applyInPandas(run, out.schema)


def differences(df: DataFrame) -> DataFrame:
    """Replaces y by its first difference; the first row of a series goes."""
    w = W.partitionBy("unique_id").orderBy("ds")
    return df.withColumn("y", F.col("y") - F.lag("y", 1).over(w)).where("y IS NOT NULL")


def trajectories(df: DataFrame, horizon: int) -> DataFrame:
    """(unique_id, ds, path): every run of ``horizon`` values in time order, named by its last time."""
    w = W.partitionBy("unique_id").orderBy("ds").rowsBetween(1 - horizon, W.currentRow)
    return df.select("unique_id", "ds", F.collect_list("y").over(w).alias("path")).where(F.size("path") == horizon)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


class FTN:
    """Corrects each member's forecast path by the mean of its nearest stored trajectories.

    ``apply_global`` stores all series' trajectories together. With
    ``apply_diff1`` trajectories are of differences, summed up from the first
    forecast; the query stays in levels unless ``diff_query``. Distances meet in
    a join by series, or of queries with all trajectories; the ``n_neighbors``
    best of each query are cut in two steps, before and after the shuffle.
    """

    def __init__(self, n_neighbors: int, horizon: int, apply_ewm: bool = False, apply_weighting: bool = False, apply_diff1: bool = False, apply_global: bool = False, ewm_smooth: float = 0.6, diff_query: bool = False):
        self.k, self.horizon = n_neighbors, horizon
        self.apply_ewm, self.apply_weighting, self.apply_diff1 = apply_ewm, apply_weighting, apply_diff1
        self.apply_global, self.ewm_smooth, self.diff_query = apply_global, ewm_smooth, diff_query
        self.alpha: dict[str, list[float]] = {}
        self.stored: DataFrame | None = None

    def fit(self, df: DataFrame) -> FTN:
        rows = smooth(df, self.ewm_smooth) if self.apply_ewm else df
        rows = differences(rows) if self.apply_diff1 else rows
        self.stored = trajectories(rows, self.horizon)
        return self

    def reset(self) -> None:
        self.stored = None

    def set_alpha_weights(self, alpha: dict[str, list[float]]) -> FTN:
        for name, values in alpha.items():
            if len(values) != self.horizon:
                raise ValueError(f"{name} has {len(values)} weights for a horizon of {self.horizon}")
        self.alpha = {k: list(map(float, v)) for k, v in alpha.items()}
        return self

    def neighbours(self, queries: DataFrame, by: list[str]) -> DataFrame:
        """``queries`` (``by``, unique_id, f) with the mean path of their nearest trajectories, ties to earlier times and smaller ids."""
        if self.stored is None:
            raise RuntimeError("fit comes before predict")
        stored = self.stored.select(F.col("unique_id").alias("t_uid"), F.col("ds").alias("t_ds"), "path")
        met = queries.crossJoin(stored) if self.apply_global else queries.join(stored, queries.unique_id == stored.t_uid)
        query = F.transform("f", lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.element_at("f", F.greatest(i, F.lit(1))))) if self.diff_query else F.col("f")
        near = W.partitionBy(*by).orderBy("d", "t_ds", "t_uid")
        best = met.withColumn("d", squared_distance(query, F.col("path"))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= self.k)
        steps = [F.avg(F.element_at("path", i + 1)).alias(f"s{i}") for i in range(self.horizon)]
        return best.groupBy(*by).agg(*steps).select(*by, F.array(*[f"s{i}" for i in range(self.horizon)]).alias("mean_path"))

    def predict(self, forecasts: DataFrame, models: list[str] | None = None) -> DataFrame:
        """``forecasts`` with a column ``m(FTN)``, or ``m(WFTN)`` where m has weights, for each member m.

        Every series needs exactly ``horizon`` rows; another number is an error.
        """
        models = member_names(forecasts, models)
        w = W.partitionBy("unique_id").orderBy("ds")
        rows = forecasts.withColumn("__h", F.row_number().over(w))
        long = rows.unpivot(["unique_id", "ds", "__h"], models, "model", "f")
        path = F.transform(F.array_sort(F.collect_list(F.struct("__h", "f"))), lambda s: s.f)
        queries = long.groupBy("unique_id", "model").agg(path.alias("f"))
        whole = F.size("f") == self.horizon
        queries = queries.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a series does not have one row for each step of the horizon")).cast("boolean")))
        found = self.neighbours(queries, ["unique_id", "model"]).join(queries, ["unique_id", "model"])
        mean = F.col("mean_path")
        if self.apply_diff1:
            changed = F.transform(mean, lambda x, i: F.when(i == 0, F.element_at("f", 1)).otherwise(x))
            mean = F.transform(changed, lambda _, i: F.aggregate(F.slice(changed, 1, i + 1), F.lit(0.0), lambda s, x: s + x))
        out = found.select("unique_id", "model", mean.alias("ftn")).groupBy("unique_id").pivot("model", models).agg(F.first("ftn"))
        joined = rows.join(out.select("unique_id", *[F.col(f"`{m}`").alias(f"__{m}") for m in models]), "unique_id")
        columns = []
        for m in models:
            value, name = F.element_at(f"__{m}", F.col("__h")), f"{m}(FTN)"
            if self.apply_weighting and m in self.alpha:
                share = F.element_at(F.array(*map(F.lit, self.alpha[m])), F.col("__h"))
                value, name = value * share + F.col(m) * (1 - share), f"{m}(WFTN)"
            columns.append(value.alias(name))
        return joined.select(*forecasts.columns, *columns)


def alpha_scores(cv: DataFrame, models: list[str], scale: float = 200.0) -> DataFrame:
    """(model, horizon, alpha): the logistic weight of m(FTN) against m by their mean SMAPE over series.

    On the scale of 200 differences of a few percent saturate; 2 gives milder weights.
    """
    pairs = [c for m in models for c in (m, f"{m}(FTN)")]
    per = cv.groupBy("unique_id", "horizon").agg(*[metrics.smape(F.col("y"), F.col(f"`{c}`"), scale).alias(f"e{i}") for i, c in enumerate(pairs)])
    mean = per.groupBy("horizon").agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(len(pairs))])
    rows = [F.struct(F.lit(m).alias("model"), (1 / (1 + F.exp(F.col(f"e{2 * i + 1}") - F.col(f"e{2 * i}")))).alias("alpha")) for i, m in enumerate(models)]
    return mean.select("horizon", F.explode(F.array(*rows)).alias("r")).select("r.model", "horizon", "r.alpha")


def rolling_alpha(alpha: DataFrame, window: int = 3) -> DataFrame:
    """(model, horizon, alpha) with alpha's mean over the last ``window`` horizons, null before there are so many."""
    w = W.partitionBy("model").orderBy("horizon").rowsBetween(1 - window, W.currentRow)
    mean = F.when(F.count("alpha").over(w) == window, F.avg("alpha").over(w))
    return alpha.select("model", "horizon", mean.alias("alpha"))
