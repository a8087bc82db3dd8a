import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.functions import transforms
from seriesmill.functions.losses import expert_loss
from seriesmill.functions.metrics import smape_term
from seriesmill.operators import ade, barycenters, cv, longhorizon, synth, synth_arrow, weighting
from seriesmill.operators.ensembles import BestOnTrain, Blast, EqAverage, LossOnTrain, Windowing
from seriesmill.operators.mixture import MLewa, MLpol
from seriesmill.panel import check_panel, check_schema, member_names
from seriesmill.plans import queries
from seriesmill.plans.sql import SQL
from seriesmill.streaming import online

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODELS = ["a", "b", "c"]


def frame(spark, rows, columns="unique_id string, ds long, y double, a double, b double, c double"):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def cvs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for uid in ("s1", "s2", "s3"):
        y = 10 + np.cumsum(rng.normal(size=30))
        for t in range(30):
            rows.append((uid, t, float(y[t]), float(y[t] + rng.normal(0, 0.2)), float(y[t] + rng.normal(0, 1)), float(y[t] + 3)))
    return frame(spark, rows), pd.DataFrame(rows, columns=["unique_id", "ds", "y", *MODELS])


def normal(df):
    """Columns and rows in one order, by keys before values."""
    df = df.copy()
    for c in df.columns:
        if not pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(str)
    keys = [c for c in df.columns if not pd.api.types.is_float_dtype(df[c])]
    return df[sorted(df.columns)].sort_values(sorted(keys) + sorted(set(df.columns) - set(keys))).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    pd.testing.assert_frame_equal(normal(queries.QUERIES[name](spark, SF).toPandas()), normal(db.execute(SQL[name]).df()), check_exact=False, rtol=1e-6, atol=1.5e-6)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def smape(y, f):
    return 2 * np.mean(np.abs(y - f) / (np.abs(y) + np.abs(f)))


def weights_of(model):
    return {r.unique_id: list(r.weights) for r in model.weights.collect()}


def shares(scores, keep):
    x = -np.array(scores)
    x = (x - x.min()) / (x.max() - x.min())
    x = np.array([v if i in keep else 0 for i, v in enumerate(x)])
    return x / x.sum() if x.sum() else x


@pytest.mark.parametrize("by_uid", [True, False])
def test_windowing(cvs, by_uid):
    df, pdf = cvs
    got = weights_of(Windowing("MS", trim_ratio=0.7, weight_by_uid=by_uid, window_size=5).fit(df, MODELS))
    scores = {u: [smape(g.y.values[-5:], g[m].values[-5:]) for m in MODELS] for u, g in pdf.groupby("unique_id")}
    mean = np.mean(list(scores.values()), axis=0)
    for u, s in scores.items():
        keep = np.argsort(s if by_uid else mean, kind="stable")[:2]
        assert got[u] == pytest.approx(shares(s, keep))
        assert sum(w > 0 for w in got[u]) <= 2


def test_best_and_equal(cvs):
    df, pdf = cvs
    best = {u: min(MODELS, key=lambda m: smape(g.y.values, g[m].values)) for u, g in pdf.groupby("unique_id")}
    for model in (BestOnTrain(), Blast("MS", weight_by_uid=True, window_size=30)):
        assert {u: MODELS[int(np.argmax(w))] for u, w in weights_of(model.fit(df, MODELS)).items()} == best
    for w in weights_of(EqAverage(0.7).fit(df, MODELS)).values():
        assert sorted(w) == [0, 0.5, 0.5]


def test_order_and_partitions_do_not_matter(cvs):
    df, _ = cvs
    for model in (lambda: MLpol("square", True), lambda: MLewa("square", True, weight_by_uid=True), lambda: Windowing("MS")):
        assert weights_of(model().fit(df, MODELS)) == weights_of(model().fit(df.orderBy(F.rand(1)).repartition(7), MODELS))


def fold(rule, rows, gradient, which):
    m = len(rows[0][1])
    r, eta, b = np.zeros(m), np.full(m, math.exp(100 if rule == "pol" else 350)), 0.0

    def weights():
        if r.max() <= 0:
            return np.full(m, 1 / m)
        raw = eta * np.maximum(r, 0) if rule == "pol" else np.clip(np.exp(np.clip(eta * r, -700, 700)), math.exp(-700), math.exp(700))
        return raw / raw.sum()

    w = weights()
    for y, f in rows:
        w = weights()
        fc = (w * f).sum()
        loss = (lambda x: 2 * (fc - y) * x) if gradient else (lambda x: (x - y) ** 2)  # noqa: B023
        g = loss(fc) - loss(f)
        r = r + g
        if rule == "pol":
            top = max(b, (g * g).max())
            eta, b = 1 / (1 / eta + g * g + top - b), top
        else:
            eta = np.sqrt(math.log(m) / (math.log(m) / eta**2 + g * g))
    return w if which == "last" else weights()


@pytest.mark.parametrize("rule", ["pol", "ewa"])
@pytest.mark.parametrize("gradient", [True, False])
@pytest.mark.parametrize("by_uid", [True, False])
@pytest.mark.parametrize("which", ["last", "next"])
def test_mixtures(cvs, rule, gradient, by_uid, which):
    df, pdf = cvs
    make = MLpol if rule == "pol" else MLewa
    got = weights_of(make("square", gradient, weight_by_uid=by_uid, which=which).fit(df, MODELS))
    for u, g in pdf.groupby("unique_id"):
        rows = (g if by_uid else pdf).sort_values(["ds", "unique_id"])
        want = fold(rule, [(r.y, np.array([r.a, r.b, r.c])) for r in rows.itertuples()], gradient, which)
        assert got[u] == pytest.approx(want, abs=1e-9)


def test_degenerate_and_missing(spark):
    rows = [("u", t, 1.0, 2.0, 2.0, 2.0) for t in range(4)]
    df = frame(spark, rows)
    for policy, want in (("zero", [0, 0, 0]), ("equal", [1 / 3] * 3), ("null", [None] * 3)):
        assert weights_of(LossOnTrain(1.0, degenerate=policy).fit(df, MODELS))["u"] == pytest.approx(want)
    assert weights_of(LossOnTrain(1.0).fit(df, ["a"]))["u"] == [0]
    model = EqAverage().fit(df, MODELS)
    new = spark.createDataFrame([("u", 9, 3.0, None, 6.0)], "unique_id string, ds long, a double, b double, c double")
    assert model.predict(new).first().EqAverage == pytest.approx(3.0)
    assert model.predict(new, renormalise=True).first().EqAverage == pytest.approx(4.5)
    other = new.withColumn("unique_id", F.lit("new"))
    assert model.predict(other, on_missing="null").first().EqAverage is None
    assert model.predict(other, on_missing="equal").first().EqAverage == pytest.approx(3.0)
    with pytest.raises(Exception, match="no weights"):
        model.predict(other).collect()


def test_arguments(spark, cvs):
    df, _ = cvs
    for bad in (lambda: Windowing("fortnight"), lambda: MLpol("cubic", True), lambda: barycenters.calc_average(df, MODELS, "median"), lambda: longhorizon.FTN(2, 3).set_alpha_weights({"a": [1.0]})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        check_panel(df.union(df))
    with pytest.raises(ValueError):
        cv.get_horizon(df.withColumn("horizon", F.lit(1)))
    with pytest.raises(TypeError):
        check_schema(df.withColumn("unique_id", F.lit(1)))
    with pytest.raises(Exception, match="missing"):
        MLpol("square", True, na="error").fit(df.withColumn("a", F.lit(None).cast("double")), MODELS).weights.collect()
    assert member_names(df.withColumn("cutoff", F.lit(1)).withColumn("h", F.lit(1))) == MODELS
    assert weighting.n_kept(0.29, 100) == 28 and weighting.n_kept(1e-10, 7) == 1
    with pytest.raises(TypeError):
        online.OnlineAugmentation([synth_arrow.KernelSynth(2, 5)])


def test_losses(spark):
    df = spark.createDataFrame([(2.0, -4.0, 1.0), (0.0, 3.0, 2.0)], "y double, f double, fc double")
    value = lambda k, g: [r[0] for r in df.select(expert_loss(k, g)(F.col("f"), F.col("y"), F.col("fc"))).collect()]
    assert value("square", False) == [36, 9]
    assert value("percentage", False) == [3, None]
    assert value("log", False) == [None, pytest.approx(-math.log(3))]
    assert value("pinball", False) == [3, 1.5]
    assert value("absolute", True) == [4, 3]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=6))
def test_array_functions(spark, values):
    df = spark.createDataFrame([(values,)], "v array<double>")
    row = df.select(transforms.min_max(F.col("v")).alias("m"), transforms.ewm(F.col("v"), 0.6).alias("e"), F.transform("v", lambda x: transforms.signed_exp(transforms.signed_log(x))).alias("b"), smape_term(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert row.z == 0 and all(0 <= x <= 1 for x in row.m)
    assert row.e == pytest.approx(pd.Series(values).ewm(alpha=0.6).mean().iloc[-1], rel=1e-9, abs=1e-9)
    assert row.b == pytest.approx(values, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("glob", [True, False])
def test_ftn(cvs, spark, glob):
    df, pdf = cvs
    train = pdf[pdf.ds < 26]
    out = longhorizon.FTN(3, 4, apply_global=glob).fit(spark.createDataFrame(train[["unique_id", "ds", "y"]])).predict(df.where("ds >= 26").drop("y"), ["a"]).toPandas()
    for u, g in pdf[pdf.ds >= 26].groupby("unique_id"):
        pool = [(np.linalg.norm(x.y.values[i : i + 4] - g.a.values), x.y.values[i : i + 4]) for k, x in train.groupby("unique_id") if glob or k == u for i in range(len(x) - 3)]
        want = np.mean([p for _, p in sorted(pool, key=lambda t: t[0])[:3]], axis=0)
        assert out[out.unique_id == u].sort_values("ds")["a(FTN)"].values == pytest.approx(want)
    with pytest.raises(Exception, match="horizon"):
        longhorizon.FTN(3, 5).fit(spark.createDataFrame(train[["unique_id", "ds", "y"]])).predict(df.where("ds >= 26").drop("y"), ["a"]).collect()


def test_generators(spark, cvs):
    df = cvs[0].select("unique_id", "ds", "y")
    for make in (synth.Jittering, synth.Scaling, synth.MagnitudeWarping, synth_arrow.TimeWarping):
        g = make(seed=1)
        first, second = g.transform(df), g.transform(df)
        assert {r.unique_id for r in first.collect()} == {f"s{i + 1}_{g.alias}{i}" for i in range(3)}
        assert {r.unique_id for r in second.collect()} == {f"s{i + 1}_{g.alias}{i + 3}" for i in range(3)}
        again, rows = (x.toPandas().sort_values(["unique_id", "ds"]) for x in (make(seed=1).transform(df.repartition(5)), first))
        assert list(again.unique_id) == list(rows.unique_id) and again.y.values == pytest.approx(rows.y.values, rel=1e-12)
        assert first.count() == 90
    assert synth.Jittering().transform(df.where("ds = 0")).where("y IS NOT NULL").count() == 0
    whole = synth.Scaling(rename_uids=False).transform(df.withColumn("y", F.col("y").cast("int")))
    assert dict(whole.dtypes)["y"] == "int"
    mixed = synth.TSMixup(3, 5, 9, seed=2).transform(df, 6).toPandas()
    assert mixed.unique_id.nunique() == 6 and mixed.groupby("unique_id").size().between(5, 9).all()
    assert mixed.y.between(df.agg(F.min("y")).first()[0], df.agg(F.max("y")).first()[0]).all()


def test_spline_is_not_a_knot():
    x = np.arange(6.0)
    cubic = lambda t: 2 + t - 0.5 * t**2 + 0.1 * t**3
    at = np.linspace(0, 5, 41)
    assert synth_arrow.spline(at, cubic(x)) == pytest.approx(cubic(at))


def test_block_bootstrap():
    g = synth_arrow.SeasonalMBB(4, max_samples=10)
    assert [(s.start, s.stop) for s in g.chunks(25)] == [(0, 10), (10, 25)]
    assert [(s.start, s.stop) for s in g.chunks(20)] == [(0, 10), (10, 20)]
    assert [(s.start, s.stop) for s in g.chunks(7)] == [(0, 7)]
    y = 5 + np.sin(np.arange(48) * np.pi / 2) + np.arange(48) / 10
    trend, season, rest = synth_arrow.stl(y, 4)
    assert trend + season + rest == pytest.approx(y) and np.abs(rest).max() < 0.5
    assert len(g._values(y, np.random.default_rng(0))) == 48 and g._values(np.array([3.0]), np.random.default_rng(0)) == pytest.approx([3.0])


def test_barycenters():
    a = np.array([0, 1, 2, 3, 2, 1.0])
    for f in (barycenters.dtw, barycenters.dtw_subgradient):
        assert f([a, a]) == pytest.approx(a)
    assert barycenters.path(np.array([0, 1, 1.0]), np.array([0, 1.0])) == [(0, 0), (1, 1), (2, 1)]
    rng = np.random.default_rng(0)
    x, y, eps = rng.normal(size=4), rng.normal(size=5), 1e-5

    def soft(x):
        r = np.full((5, 6), np.inf)
        r[0, 0] = 0
        for i in range(4):
            for j in range(5):
                z = np.array([r[i, j], r[i, j + 1], r[i + 1, j]])
                r[i + 1, j + 1] = (x[i] - y[j]) ** 2 - np.log(np.exp(-(z - z.min())).sum()) + z.min()
        return r[4, 5]

    want = [(soft(x + eps * np.eye(4)[i]) - soft(x - eps * np.eye(4)[i])) / (2 * eps) for i in range(4)]
    assert barycenters._soft_gradient(x, y, 1.0) == pytest.approx(want, rel=1e-4)


def test_ade(cvs):
    df, pdf = cvs
    model = ade.ADE("MS", meta_lags=[1], meta_model=ade.LeastSquares(1)).fit(df, MODELS).set_train(df)
    pdf = pdf.sort_values(["unique_id", "ds"])
    lag = pdf.groupby("unique_id").y.shift(1)
    for u, w in weights_of(model).items():
        last = pdf[pdf.unique_id == u].y.iloc[-1]
        errors = []
        for m in MODELS:
            slope, base = np.polyfit(lag[lag.notna()], (pdf[m] - pdf.y)[lag.notna()], 1)
            errors.append(abs(slope * last + base))
        assert w == pytest.approx(shares(errors, range(3)), abs=1e-8)


def test_split_is_a_partition(cvs):
    df, _ = cvs
    train, test = cv.train_test_split(df, 4)
    assert train.count() == 78 and test.count() == 12 and train.intersect(test).isEmpty()


def test_batches(spark):
    batch = spark.createDataFrame([(0, [1.0, 2.0, 0.0], [1.0, 1.0, 0.0]), (1, [3.0, 4.0, 5.0], [1.0, 1.0, 1.0])], "position int, y array<float>, y_mask array<float>")
    back = {r.unique_id: (r.y, r.y_mask) for r in online.panel_to_batch(online.batch_to_panel(batch)).collect()}
    assert back == {"ID0": ([1, 2, 0], [1, 1, 0]), "ID1": ([3, 4, 5], [1, 1, 1])}
    more = online.OnlineAugmentation(synth.Scaling(sigma=0.0, names=synth.DEFAULT)).augment_batch(batch)
    assert more.count() == 4


def test_stream_equals_fold(spark):
    got = {r.unique_id: r for r in queries.online_mlpol(spark, SF).collect()}
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    for u, g in events.groupby("event_type"):
        want = fold("pol", [(v, np.array([10.0, 50.0, 30.0])) for v in g.value], True, "next")
        assert [got[u].low, got[u].high, got[u].middle] == pytest.approx(want, abs=1e-5) and got[u].n == len(g)
