"""Arbitrated dynamic ensembles: members weighted by the errors a meta-model expects of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators import weighting
from seriesmill.operators.ensembles import Ensemble
from seriesmill.panel import member_names


def lag_names(lags: list[int]) -> list[str]:
    return [f"lag{i}" for i in lags]


def member_errors(df: DataFrame, models: list[str]) -> DataFrame:
    """(unique_id, ds, y, members): signed errors in place of forecasts; of several horizons only the first."""
    rows = df.where("h = 1").drop("h") if "h" in df.columns else df
    return rows.select("unique_id", "ds", "y", *[(F.col(m) - F.col("y")).alias(m) for m in models])


def lag_matrix(df: DataFrame, lags: list[int], columns: list[str]) -> DataFrame:
    """Adds lags of y within series; rows without all of them go."""
    w = W.partitionBy("unique_id").orderBy("ds")
    out = df.select("unique_id", "ds", "y", *columns, *[F.lag("y", i).over(w).alias(f"lag{i}") for i in lags])
    return out.na.drop(subset=lag_names(lags))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the last one of the series before, else the first one after."""
    w = W.partitionBy("unique_id").orderBy("ds")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) for c in columns})


def last_lags(train: DataFrame, lags: list[int]) -> DataFrame:
    """(unique_id, lag columns) at the first step after each series: its i-th last value."""
    rank = F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))
    rows = train.select("unique_id", "y", rank.alias("rank")).where(F.col("rank") <= max(lags))
    return rows.groupBy("unique_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("y"))).alias(f"lag{i}") for i in lags])


class LeastSquares:
    """A line in one lag for each member, from sums of one aggregation; the coefficients stay a one-row table."""

    def __init__(self, lag: int = 1):
        self.lag = f"lag{lag}"

    def fit(self, rows: DataFrame, features: list[str], targets: list[str]) -> LeastSquares:
        columns = []
        for i, t in enumerate(targets):
            columns += [F.regr_slope(t, self.lag).alias(f"__s{i}"), F.regr_intercept(t, self.lag).alias(f"__i{i}")]
        self.table, self.targets = rows.agg(*columns), targets
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows.crossJoin(F.broadcast(self.table))
        return out.select("unique_id", *[(F.col(f"__s{i}") * F.col(self.lag) + F.col(f"__i{i}")).alias(t) for i, t in enumerate(self.targets)])


class MLRegressors:
    """One pyspark.ml regressor a member, made by ``make(features column, label column)``."""

    def __init__(self, make: Callable):
        self.make = make

    def fit(self, rows: DataFrame, features: list[str], targets: list[str]) -> MLRegressors:
        from pyspark.ml.feature import VectorAssembler

        self.assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
        ready = self.assembler.transform(rows).select("__x", *targets).persist()
        self.fitted = {t: self.make("__x", t).fit(ready.where(F.col(t).isNotNull())) for t in targets}
        ready.unpersist()
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.assembler.transform(rows)
        for t, model in self.fitted.items():
            out = model.setPredictionCol(t).transform(out)
        return out.select("unique_id", *self.fitted)


def boosted_trees() -> MLRegressors:
    from pyspark.ml.regression import GBTRegressor

    return MLRegressors(lambda x, y: GBTRegressor(featuresCol=x, labelCol=y, maxIter=10, maxDepth=3, seed=1))


def linear(reg: float = 0.0) -> MLRegressors:
    from pyspark.ml.regression import LinearRegression

    return MLRegressors(lambda x, y: LinearRegression(featuresCol=x, labelCol=y, regParam=reg))


class ADE(Ensemble):
    """A meta-model expects each member's error from lags of y; small expected errors weigh more.

    ``meta_lags`` None means lag 1 and lag window + 1, those two. Weights come
    from the lags at the first future step and hold for the whole horizon; the
    best by SMAPE of the whole history are kept, for each series or for all.
    """

    alias = "ADE"

    def __init__(self, freq: str, meta_lags: list[int] | None = None, trim_ratio: float = 1.0, trim_by_uid: bool = True, meta_model=None, degenerate: str = "zero"):
        super().__init__(trim_ratio, degenerate)
        self.lags = meta_lags or [1, weighting.window_size(freq) + 1]
        self.trim_by_uid, self.meta_model = trim_by_uid, meta_model

    def _fit(self, insample: DataFrame) -> None:
        self.scores = weighting.model_scores(insample, self.models)
        rows = filled(lag_matrix(member_errors(insample, self.models), self.lags, self.models), self.models)
        self.meta = (self.meta_model or linear()).fit(rows, lag_names(self.lags), self.models)

    def set_train(self, train: DataFrame) -> ADE:
        expected = self.meta.predict(last_lags(train, self.lags))
        errors = expected.select("unique_id", F.array(*[F.abs(F.col(m)) for m in self.models]).alias("expected"))
        scores = self.scores
        if self.trim_by_uid:
            keep = scores.select("unique_id", weighting.ranked(F.col("scores"), self.kept).alias("keep"))
        else:
            best = weighting.global_scores(scores, len(self.models)).select(weighting.ranked(F.col("mean_scores"), self.kept).alias("keep"))
            keep = scores.select("unique_id").crossJoin(F.broadcast(best))
        shares = weighting.normalize_and_proportion(F.transform("expected", lambda x: -x))
        self.weights = errors.join(keep, "unique_id").select("unique_id", weighting.trimmed(shares, F.col("keep"), self.degenerate).alias("weights"))
        return self

    def predict(self, forecasts: DataFrame, train: DataFrame | None = None, on_missing: str = "error", renormalise: bool = False) -> DataFrame:
        if train is not None:
            self.set_train(train)
        return super().predict(forecasts, on_missing, renormalise)


class ForecasterADE(ADE):
    """ADE over forecasters that it runs itself.

    A forecaster is a function (panel, horizon or None) -> forecasts: of the
    past by rows of the panel where the horizon is None, else of the future.
    """

    alias = "ForecasterADE"

    def __init__(self, forecasters: list[Callable], freq: str, trim_ratio: float = 1.0, meta_lags: list[int] | None = None, meta_model=None):
        super().__init__(freq, meta_lags, trim_ratio, True, meta_model)
        self.forecasters = forecasters

    def _joined(self, panel: DataFrame, horizon: int | None) -> DataFrame:
        out = None
        for f in self.forecasters:
            found = f(panel, horizon)
            out = found if out is None else out.join(found.drop("y"), ["unique_id", "ds"])
        return out

    def fit(self, panel: DataFrame, models: list[str] | None = None) -> ForecasterADE:
        self.panel = panel
        past = self._joined(panel, None)
        return super().fit(past, member_names(past, models))

    def predict(self, horizon: int, train: DataFrame | None = None) -> DataFrame:
        panel = self.panel if train is None else train
        return super().predict(self._joined(panel, horizon), panel)
