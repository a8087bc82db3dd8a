"""Static and windowed combination rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators import weighting
from seriesmill.panel import member_names


class Ensemble:
    """Fits weights on forecasts with actual values (unique_id, ds, y, members) and combines new ones.

    ``weights`` and ``scores`` are DataFrames, evaluated with the query that
    uses them. ``degenerate`` says what becomes of a series whose weights are
    all zero: one member, equal scores, or a global choice that is its worst.
    """

    alias = "Ensemble"

    def __init__(self, trim_ratio: float = 1.0, degenerate: str = "zero"):
        if degenerate not in ("zero", "equal", "null"):
            raise ValueError("degenerate must be 'zero', 'equal' or 'null'")
        self.trim_ratio, self.degenerate = trim_ratio, degenerate
        self.models: list[str] = []
        self.scores: DataFrame | None = None
        self.weights: DataFrame | None = None

    def fit(self, insample: DataFrame, models: list[str] | None = None) -> Ensemble:
        self.models = member_names(insample, models)
        if not self.models:
            raise ValueError("there is no member to combine")
        self._fit(insample)
        return self

    @property
    def kept(self) -> int:
        return weighting.n_kept(self.trim_ratio, len(self.models))

    def predict(self, forecasts: DataFrame, on_missing: str = "error", renormalise: bool = False) -> DataFrame:
        if self.weights is None:
            raise RuntimeError("fit comes before predict")
        if "unique_id" not in forecasts.columns:
            raise ValueError("forecasts have no unique_id")
        return weighting.combine(forecasts, self.weights, self.models, self.alias, on_missing, renormalise)

    def weights_table(self) -> DataFrame:
        return weighting.wide(self.weights, self.models)

    def _fit(self, insample: DataFrame) -> None:
        raise NotImplementedError


class Windowing(Ensemble):
    """Weights from the SMAPE of each series' last rows; ``select_best`` keeps one member."""

    alias = "Windowing"

    def __init__(self, freq: str, select_best: bool = False, trim_ratio: float = 1.0, weight_by_uid: bool = False, window_size: int | None = None, degenerate: str = "zero"):
        super().__init__(1e-10 if select_best else trim_ratio, degenerate)
        self.by_uid = weight_by_uid
        self.window = weighting.window_size(freq, window_size)

    def _fit(self, insample: DataFrame) -> None:
        self.scores = weighting.model_scores(insample, self.models, self.window)
        self.weights = weighting.score_weights(self.scores, len(self.models), self.kept, self.by_uid, self.degenerate)


class Blast(Windowing):
    """The best member of the window, for each series or for all."""

    alias = "BLAST"

    def __init__(self, freq: str, weight_by_uid: bool = False, window_size: int | None = None, degenerate: str = "zero"):
        super().__init__(freq, True, 1.0, weight_by_uid, window_size, degenerate)


class LossOnTrain(Ensemble):
    """Weights from the SMAPE of each series' whole history."""

    alias = "LossOnTrain"

    def __init__(self, trim_ratio: float, weight_by_uid: bool = True, degenerate: str = "zero"):
        super().__init__(trim_ratio, degenerate)
        self.by_uid = weight_by_uid

    def _fit(self, insample: DataFrame) -> None:
        self.scores = weighting.model_scores(insample, self.models)
        self.weights = weighting.score_weights(self.scores, len(self.models), self.kept, self.by_uid, self.degenerate)


class BestOnTrain(LossOnTrain):
    """The best member of the whole history, for each series or for all."""

    alias = "BestOnTrain"

    def __init__(self, select_by_uid: bool = True, degenerate: str = "zero"):
        super().__init__(1e-10, select_by_uid, degenerate)


class EqAverage(Ensemble):
    """The mean of the members that trimming leaves."""

    alias = "EqAverage"

    def __init__(self, trim_ratio: float = 1.0, select_by_uid: bool = True):
        super().__init__(trim_ratio)
        self.by_uid = select_by_uid

    def _fit(self, insample: DataFrame) -> None:
        self.scores = weighting.model_scores(insample, self.models)
        keyed = self.scores
        if self.by_uid:
            keyed = keyed.withColumn("keep", weighting.ranked(F.col("scores"), self.kept))
        else:
            best = weighting.global_scores(keyed, len(self.models)).select(weighting.ranked(F.col("mean_scores"), self.kept).alias("keep"))
            keyed = keyed.crossJoin(F.broadcast(best))
        even = F.transform("scores", lambda _: F.lit(1.0))
        self.weights = keyed.select("unique_id", weighting.trimmed(even, F.col("keep"), "zero").alias("weights"))
