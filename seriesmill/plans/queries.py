"""One query for each operator, over panels of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions import metrics, transforms
from seriesmill.functions.losses import LOSSES, expert_loss
from seriesmill.operators import ade, barycenters, cv, longhorizon, synth, synth_arrow, weighting
from seriesmill.operators.ensembles import BestOnTrain, Blast, EqAverage, LossOnTrain, Windowing
from seriesmill.operators.mixture import MLewa, MLpol
from seriesmill.panel import with_times
from seriesmill.shared import shared_dir
from seriesmill.sources import panels
from seriesmill.streaming import online

MODELS = ["naive", "ma3", "snaive"]
HOLDOUT = 6
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, dates as text; what both engines compute alike."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), own.get(name, digits)) + F.lit(0.0)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind == "int":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def forecasts(spark: SparkSession, sf_dir: str, source=panels.month_priority) -> tuple[DataFrame, DataFrame]:
    """Members' forecasts with actual values, and the last HOLDOUT rows of each series."""
    rows = panels.members(source(spark, sf_dir)).select("unique_id", "ds", "y", *MODELS)
    return cv.train_test_split(rows, HOLDOUT)


def rule(model, source=panels.month_priority, weights: bool = False):
    """A query that fits a rule and returns its weights, or combined forecasts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        past, future = forecasts(spark, sf_dir, source)
        fitted = model().fit(past, MODELS)
        if weights:
            return shown(fitted.weights_table())
        out = fitted.predict(future.drop("y"))
        return shown(out.select("unique_id", "ds", F.col(fitted.alias).alias("forecast")), 2)

    return run


@query
def panel_month_priority(spark, sf_dir):
    return shown(panels.month_priority(spark, sf_dir), 2)


@query
def panel_month_nation(spark, sf_dir):
    return shown(panels.month_nation(spark, sf_dir), 2)


@query
def panel_month_flag(spark, sf_dir):
    return shown(panels.month_flag(spark, sf_dir), 2)


@query
def panel_hour_event(spark, sf_dir):
    return shown(panels.hour_event(spark, sf_dir), 2)


@query
def members(spark, sf_dir):
    return shown(panels.members(panels.month_priority(spark, sf_dir)), 2, ols=0)


RULES = {
    "windowing_forecast": (lambda: Windowing("MS", weight_by_uid=True), {}),
    "windowing_by_uid": (lambda: Windowing("MS", weight_by_uid=True, trim_ratio=0.8), {"weights": True}),
    "windowing_global_trim": (lambda: Windowing("MS", trim_ratio=0.8), {"weights": True}),
    "windowing_nation": (lambda: Windowing("MS", weight_by_uid=True, trim_ratio=0.8), {"source": panels.month_nation}),
    "blast": (lambda: Blast("MS", weight_by_uid=True), {}),
    "blast_global": (lambda: Blast("MS"), {"weights": True}),
    "loss_on_train": (lambda: LossOnTrain(0.8), {}),
    "loss_on_train_weights": (lambda: LossOnTrain(1.0), {"weights": True, "source": panels.month_nation}),
    "best_on_train": (lambda: BestOnTrain(), {"weights": True}),
    "best_on_train_global": (lambda: BestOnTrain(select_by_uid=False), {}),
    "eq_average": (lambda: EqAverage(), {}),
    "eq_average_trim": (lambda: EqAverage(0.8), {"weights": True}),
    "mlpol_global_grad": (lambda: MLpol("square", True), {"weights": True}),
    "mlpol_forecast": (lambda: MLpol("square", True), {}),
    "mlpol_uid": (lambda: MLpol("square", True, weight_by_uid=True), {"weights": True}),
    "mlpol_next": (lambda: MLpol("square", True, weight_by_uid=True, which="next"), {"weights": True}),
    "mlpol_trim": (lambda: MLpol("square", True, weight_by_uid=True, trim_ratio=0.8), {"weights": True}),
    "mlpol_absolute": (lambda: MLpol("absolute", True, weight_by_uid=True), {"weights": True}),
    "mlpol_percentage": (lambda: MLpol("percentage", True, weight_by_uid=True), {"weights": True}),
    "mlpol_log": (lambda: MLpol("log", True, weight_by_uid=True), {"weights": True}),
    "mlpol_pinball": (lambda: MLpol("pinball", True, weight_by_uid=True), {"weights": True}),
    "mlpol_square_loss": (lambda: MLpol("square", False, weight_by_uid=True), {"weights": True}),
    "mlewa_global_grad": (lambda: MLewa("square", True), {"weights": True}),
    "mlewa_uid": (lambda: MLewa("square", True, weight_by_uid=True), {"weights": True}),
    "mlewa_absolute": (lambda: MLewa("absolute", False, weight_by_uid=True), {"weights": True}),
}
QUERIES |= {name: rule(make, **how) for name, (make, how) in RULES.items()}


def undefined(model):
    """Weights where a target or a forecast leaves some losses undefined: March has no orders, the naive forecast for June is negative."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        past = forecasts(spark, sf_dir)[0]
        past = past.withColumns({"y": F.when(F.month("ds") == 3, F.lit(0.0)).otherwise(F.col("y")), "naive": F.when(F.month("ds") == 6, -F.col("naive")).otherwise(F.col("naive"))})
        return shown(model().fit(past, MODELS).weights_table())

    return run


QUERIES |= {
    "mlpol_zero_percentage": undefined(lambda: MLpol("percentage", False, weight_by_uid=True)),
    "mlpol_zero_gradient": undefined(lambda: MLpol("percentage", True, weight_by_uid=True)),
    "mlpol_negative_log": undefined(lambda: MLpol("log", False, weight_by_uid=True)),
    "mlewa_zero_absolute": undefined(lambda: MLewa("absolute", False, weight_by_uid=True, which="next")),
}


@query
def evaluate_join(spark, sf_dir):
    """Test rows left-joined with forecasts for every other month, scored by member."""
    future = forecasts(spark, sf_dir)[1]
    known = future.where(F.month("ds") % 2 == 0).drop("y")
    return shown(metrics.accuracy(future.select("unique_id", "ds", "y"), known, MODELS))


@query
def evaluate_by_group(spark, sf_dir):
    """As evaluate_join, by a group of the test rows: the half of the year."""
    future = forecasts(spark, sf_dir)[1].withColumn("half", F.when(F.month("ds") <= 6, "first").otherwise("second"))
    return shown(metrics.accuracy(future.select("unique_id", "ds", "y", "half"), future.drop("y", "half"), MODELS, ["half"]))


@query
def smape_full(spark, sf_dir):
    return shown(metrics.scores_by_series(forecasts(spark, sf_dir)[0], MODELS, ["unique_id"]))


@query
def smape_window(spark, sf_dir):
    return shown(metrics.scores_by_series(weighting.last_rows(forecasts(spark, sf_dir)[0], 12), MODELS, ["unique_id"]))


@query
def leaderboard(spark, sf_dir):
    return shown(metrics.leaderboard(forecasts(spark, sf_dir)[1], MODELS))


@query
def norm_proportion(spark, sf_dir):
    scores = weighting.model_scores(forecasts(spark, sf_dir)[0], MODELS)
    out = scores.withColumn("weights", transforms.normalize_and_proportion(F.transform("scores", lambda x: -x)))
    return shown(weighting.wide(out, MODELS))


@query
def minmax(spark, sf_dir):
    scores = weighting.model_scores(forecasts(spark, sf_dir)[0], MODELS)
    return shown(weighting.wide(scores.withColumn("weights", transforms.min_max(F.col("scores"))), MODELS))


@query
def topk_models(spark, sf_dir):
    scores = weighting.model_scores(forecasts(spark, sf_dir, panels.month_nation)[0], MODELS)
    named = F.transform(weighting.ranked(F.col("scores"), 2), lambda i: F.element_at(F.array(*map(F.lit, MODELS)), i + 1))
    return scores.select("unique_id", F.posexplode(named).alias("at", "model")).select("unique_id", (F.col("at") + 1).cast("long").alias("rank"), "model")


@query
def train_test_split(spark, sf_dir):
    train, test = cv.train_test_split(panels.month_priority(spark, sf_dir), HOLDOUT)
    return shown(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))), 2)


@query
def nested_split(spark, sf_dir):
    train, test = cv.train_test_split(panels.month_priority(spark, sf_dir), HOLDOUT)
    dev, valid = cv.train_test_split(train, HOLDOUT)
    parts = dev.withColumn("part", F.lit("dev")).unionByName(valid.withColumn("part", F.lit("valid"))).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("unique_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ds").cast("string").alias("first"), F.max("ds").cast("string").alias("last"))


def with_cutoff(df: DataFrame, steps: int) -> DataFrame:
    """Numbers rows into windows of ``steps``, named by their first time."""
    w = W.partitionBy("unique_id").orderBy("ds")
    rows = df.withColumn("w", F.floor((F.row_number().over(w) - 1) / steps))
    return rows.withColumn("cutoff", F.min("ds").over(W.partitionBy("unique_id", "w"))).drop("w")


@query
def get_horizon(spark, sf_dir):
    return shown(cv.get_horizon(panels.month_priority(spark, sf_dir)), 2)


@query
def get_horizon_cutoff(spark, sf_dir):
    return shown(cv.get_horizon(with_cutoff(panels.month_priority(spark, sf_dir), 4)), 2)


@query
def cv_first_step(spark, sf_dir):
    return shown(cv.first_steps(with_cutoff(panels.month_priority(spark, sf_dir), 4)), 2)


@query
def n_windows(spark, sf_dir):
    return cv.n_windows(panels.month_nation(spark, sf_dir), 3, 6)


@query
def signed_log(spark, sf_dir):
    rows = panels.month_priority(spark, sf_dir)
    z = F.col("y") - F.avg("y").over(W.partitionBy("unique_id"))
    return shown(rows.select("unique_id", "ds", transforms.signed_log(z).alias("z"), transforms.signed_exp(transforms.signed_log(F.round(z / 1e6, 3))).alias("back")))


@query
def dense_grid_mask(spark, sf_dir):
    hours = panels.hour_event(spark, sf_dir)
    start = hours.agg(F.min("ds").alias("start"))
    placed = hours.crossJoin(F.broadcast(start)).select("unique_id", F.expr("timestampdiff(HOUR, start, ds)").alias("ds"), "y")
    return shown(cv.dense_grid(placed))


def losses(gradient: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = forecasts(spark, sf_dir)[0].select("unique_id", "ds", (F.col("y") / 1e6).alias("y"), (F.col("naive") / 1e6).alias("f"), (F.col("ma3") / 1e6).alias("fc"))
        y, f, fc = F.col("y"), F.col("f"), F.col("fc")
        return shown(rows.select("unique_id", "ds", *[expert_loss(k, gradient)(f, y, fc).alias(k) for k in (*LOSSES, "pinball")]), 9)

    return run


QUERIES |= {"expert_losses": losses(False), "expert_gradients": losses(True)}


@query
def ewm_smooth(spark, sf_dir):
    return shown(longhorizon.smooth(panels.month_priority(spark, sf_dir)), 2)


@query
def ewm_long(spark, sf_dir):
    """A slow mean, whose window would be long."""
    return shown(longhorizon.smooth(panels.month_priority(spark, sf_dir), 0.05), 2)


@query
def diff1(spark, sf_dir):
    return shown(longhorizon.differences(panels.month_priority(spark, sf_dir)), 2)


@query
def trajectories(spark, sf_dir):
    rows = longhorizon.trajectories(panels.month_priority(spark, sf_dir), 3)
    return shown(rows.select("unique_id", "ds", *[F.element_at("path", i + 1).alias(f"s{i}") for i in range(3)]), 2)


def ftn(weighted: bool = False, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        past, future = forecasts(spark, sf_dir)
        train = past.select("unique_id", "ds", "y")
        model = longhorizon.FTN(5, HOLDOUT, apply_weighting=weighted, **how).fit(train)
        if weighted:
            model.set_alpha_weights({"naive": [0.1 * (i + 1) for i in range(HOLDOUT)]})
        out = model.predict(future.drop("y"), ["naive", "snaive"])
        names = {c: c.replace("(", "_").replace(")", "") for c in out.columns if "(" in c}
        return shown(out.select("unique_id", "ds", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), 2)

    return run


QUERIES |= {"ftn_predict": ftn(), "ftn_ewm": ftn(apply_ewm=True), "ftn_diff1": ftn(apply_diff1=True), "ftn_global": ftn(apply_global=True), "wftn_predict": ftn(weighted=True)}


@query
def alpha_cv(spark, sf_dir):
    past, future = forecasts(spark, sf_dir)
    model = longhorizon.FTN(5, HOLDOUT).fit(past.select("unique_id", "ds", "y"))
    out = model.predict(future, ["naive"])
    return shown(longhorizon.alpha_scores(cv.get_horizon(out), ["naive"], scale=2.0))


@query
def alpha_rolling(spark, sf_dir):
    past, future = forecasts(spark, sf_dir)
    out = longhorizon.FTN(5, HOLDOUT).fit(past.select("unique_id", "ds", "y")).predict(future, ["naive"])
    return shown(longhorizon.rolling_alpha(longhorizon.alpha_scores(cv.get_horizon(out), ["naive"], scale=2.0)))


@query
def times_from_text(spark, sf_dir):
    """A panel whose times come as text."""
    rows = panels.hour_event(spark, sf_dir).withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))
    return with_times(rows).groupBy("unique_id", F.hour("ds").cast("long").alias("hour")).agg(F.sum("y").alias("y"))


@query
def jitter(spark, sf_dir):
    return shown(synth.Jittering(seed=7).transform(panels.month_priority(spark, sf_dir)), 2)


@query
def scaling(spark, sf_dir):
    return shown(synth.Scaling(seed=7).transform(panels.month_priority(spark, sf_dir)), 2)


@query
def augment_union(spark, sf_dir):
    return shown(synth.Scaling(seed=7).augment(panels.month_priority(spark, sf_dir)), 2)


@query
def magnitude_warp(spark, sf_dir):
    return shown(synth.MagnitudeWarping(seed=7).transform(panels.month_priority(spark, sf_dir)), 2)


@query
def tsmixup(spark, sf_dir):
    return shown(synth.TSMixup(4, 10, 40, seed=7).transform(panels.month_nation(spark, sf_dir)), 2)


@query
def time_warp(spark, sf_dir):
    return shown(synth_arrow.TimeWarping(seed=7).transform(panels.month_priority(spark, sf_dir)), 2)


@query
def seasonal_mbb(spark, sf_dir):
    return shown(synth_arrow.SeasonalMBB(12, seed=7).transform(panels.month_nation(spark, sf_dir)), 2)


@query
def mbb_chunked(spark, sf_dir):
    return shown(synth_arrow.SeasonalMBB(24, max_samples=200, seed=7).transform(panels.hour_event(spark, sf_dir)), 4)


@query
def dba(spark, sf_dir):
    return shown(synth_arrow.DBA(3, seed=7).transform(panels.month_priority(spark, sf_dir)), 2)


@query
def kernel_synth(spark, sf_dir):
    return shown(synth_arrow.KernelSynth(4, 60, seed=7).transform(spark, 8))


@query
def euclidean_barycenter(spark, sf_dir):
    return shown(barycenters.calc_average(forecasts(spark, sf_dir)[1], MODELS), 2)


def barycenter(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = forecasts(spark, sf_dir)[1].select("unique_id", "ds", *[(F.col(m) / 1e6).alias(m) for m in MODELS])
        return shown(barycenters.calc_average(rows, MODELS, kind))

    return run


QUERIES |= {f"{k}_barycenter": barycenter(k) for k in ("dtw", "dtw_subgradient", "softdtw")}


@query
def ade_errors(spark, sf_dir):
    return shown(ade.member_errors(forecasts(spark, sf_dir)[0], MODELS), 2)


@query
def ade_lag_matrix(spark, sf_dir):
    past = forecasts(spark, sf_dir)[0]
    return shown(ade.lag_matrix(ade.member_errors(past, MODELS), [1, 13], MODELS), 2)


def ade_rule(meta, weights: bool, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        past, future = forecasts(spark, sf_dir)
        model = ade.ADE("MS", meta_model=meta(), **how).fit(past, MODELS).set_train(past)
        if weights:
            return shown(model.weights_table())
        return shown(model.predict(future.drop("y")).select("unique_id", "ds", F.col("ADE").alias("forecast")), 2)

    return run


QUERIES |= {
    "ade_weights_ols": ade_rule(lambda: ade.LeastSquares(1), True, meta_lags=[1]),
    "ade_forecast_ols": ade_rule(lambda: ade.LeastSquares(1), False, meta_lags=[1], trim_ratio=0.8),
    "ade_linear": ade_rule(ade.linear, True),
    "ade_gbt": ade_rule(ade.boosted_trees, True, meta_lags=[1, 2, 3]),
}


@query
def ade_forecasters(spark, sf_dir):
    """ADE over forecasters that it runs: last value, and last season's value."""

    def lagged(name: str, steps: int):
        def run(panel: DataFrame, horizon: int | None) -> DataFrame:
            w = W.partitionBy("unique_id").orderBy("ds")
            if horizon is None:
                return panel.withColumn(name, F.lag("y", steps).over(w)).where(F.col(name).isNotNull())
            back = F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))
            ends = panel.withColumn("back", back).where(F.col("back") <= steps)
            last = panel.groupBy("unique_id").agg(F.max("ds").alias("end"))
            ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("back", steps - (F.col("step") - 1) % steps)
            return ahead.join(ends.select("unique_id", "back", F.col("y").alias(name)), ["unique_id", "back"]).select("unique_id", F.add_months("end", F.col("step")).alias("ds"), name)

        return run

    model = ade.ForecasterADE([lagged("naive", 1), lagged("snaive", 12)], "MS", meta_lags=[1], meta_model=ade.LeastSquares(1))
    out = model.fit(panels.month_priority(spark, sf_dir)).predict(HOLDOUT)
    return shown(out.select("unique_id", "ds", F.col(model.alias).alias("forecast")), 2)


def _streamed(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    """Runs ``write`` (stream of event rows, out folder, checkpoint folder) to its end; returns what it wrote."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = panels.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    write(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def online_augment(spark, sf_dir):
    """Event values by type, each micro-batch with jittered copies."""

    def write(stream: DataFrame, out: str, checkpoint: str):
        rows = stream.select(F.col("event_type").alias("unique_id"), F.col("event_id").alias("ds"), F.col("value").alias("y"))
        return online.OnlineAugmentation([synth.Jittering(seed=7), synth.Scaling(seed=7)]).write(rows, out, checkpoint)

    return shown(_streamed(spark, sf_dir, write).select("unique_id", "ds", "y"), 4)


@query
def online_mlpol(spark, sf_dir):
    """Mixture weights by event type, learned as events come: two constant members and their mean."""

    def write(stream: DataFrame, out: str, checkpoint: str):
        rows = stream.select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("event_id"), F.col("value").alias("y"))
        rows = rows.select("unique_id", "ds", "event_id", "y", F.lit(10.0).alias("low"), F.lit(50.0).alias("high"), F.lit(30.0).alias("middle"))
        found = online.online_weights(rows, ["low", "high", "middle"], tie="event_id")
        return found.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    rows = _streamed(spark, sf_dir, write)
    last = rows.groupBy("unique_id").agg(F.max_by("weights", "n").alias("weights"), F.max("n").alias("n"))
    return shown(last.select("unique_id", "n", *[F.element_at("weights", i + 1).alias(m) for i, m in enumerate(("low", "high", "middle"))]))


@query
def knn_embeddings(spark, sf_dir):
    """The three vectors nearest each label's mean, by Euclidean distance; there are as many queries as labels."""
    rows = panels.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    parts = rows.select("label", F.posexplode("e").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c"))
    queries = means.select(F.col("label").alias("query"), F.transform("c", lambda s: s.x).alias("q"))
    d = longhorizon.squared_distance(F.col("q"), F.col("e"))
    met = rows.crossJoin(queries).select("query", "vec_id", d.alias("d"))
    near = met.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d", "vec_id"))).where("rank <= 3")
    return shown(near.select(F.col("query").cast("long").alias("query"), "rank", "vec_id", F.sqrt("d").alias("distance")))
