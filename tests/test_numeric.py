"""Queries without SQL, and numerical routines, against plain versions."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill import shared
from seriesmill.functions import metrics, rng
from seriesmill.operators import ade, barycenters, longhorizon, mixture, synth_arrow
from seriesmill.operators.mixture import MLewa, MLpol
from seriesmill.plans import queries
from seriesmill.sources import panels
from seriesmill.streaming import online

SF = "/root/testdata/sf0.001"


def series(df, column="y"):
    return {k: g.sort_values("ds")[column].to_numpy(dtype=float) for k, g in df.groupby("unique_id")}


def plain_spline(knots, at):
    """The not-a-knot cubic through knots at 0..n-1, by solving for all coefficients of all pieces."""
    n = len(knots) - 1
    rows, right = [], []

    def add(pairs, value):
        row = np.zeros(4 * n)
        for i, powers in pairs:
            row[4 * i : 4 * i + 4] += powers
        rows.append(row)
        right.append(value)

    for i in range(n):
        add([(i, [1, 0, 0, 0])], knots[i])
        add([(i, [1, 1, 1, 1])], knots[i + 1])
        if i + 1 < n:
            add([(i, np.array([0, 1, 2, 3])), (i + 1, np.array([0, -1, 0, 0]))], 0)
            add([(i, np.array([0, 0, 2, 6])), (i + 1, np.array([0, 0, -2, 0]))], 0)
    for i in (0, n - 2):
        add([(i, np.array([0, 0, 0, 6.0])), (i + 1, np.array([0, 0, 0, -6.0]))], 0)
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    i = min(int(at), n - 1)
    return sum(c[i, k] * (at - i) ** k for k in range(4))


def test_time_warp_query(spark):
    source, found = series(panels.month_priority(spark, SF).toPandas()), series(queries.QUERIES["time_warp"](spark, SF).toPandas())
    for number, (uid, y) in enumerate(sorted(source.items())):
        n, draws = len(y), synth_arrow.generator_of(7, "TIM", uid).normal(1, 0.2, 6)
        knots = [k * (n - 1) / 5 * d for k, d in enumerate(draws)]
        warp = [plain_spline(knots, i * 5 / (n - 1)) for i in range(n)]
        assert found[f"{uid}_TIM{number}"] == pytest.approx(np.interp(range(n), warp, y), abs=0.011, rel=1e-9)


@pytest.mark.parametrize(("name", "source", "period", "chunk"), [("seasonal_mbb", panels.month_nation, 12, None), ("mbb_chunked", panels.hour_event, 24, 200)])
def test_block_bootstrap_queries(spark, name, source, period, chunk):
    """Per chunk: trend and season plus residuals that are runs of a period cut from the chunk's own residuals."""
    given, found = series(source(spark, SF).toPandas()), series(queries.QUERIES[name](spark, SF).toPandas())
    for number, (uid, y) in enumerate(sorted(given.items())):
        z, out, rnd = np.sign(y) * np.log1p(np.abs(y)), [], synth_arrow.generator_of(7, "MBB", uid)
        edges = [0, len(z)] if not chunk or len(z) <= chunk else [*range(0, len(z) - len(z) % chunk if len(z) % chunk == 0 else len(z) // chunk * chunk, chunk), len(z)]
        for a, b in itertools.pairwise(edges):
            part = z[a:b]
            if len(part) < 2 * period:
                out += list(part.mean() + rnd.choice(part - part.mean(), len(part)) if len(part) > 1 else part)
                continue
            trend, season, rest = synth_arrow.stl(part, period)
            assert trend + season + rest == pytest.approx(part)
            starts = rnd.integers(0, len(part) - period + 1, len(part) // period + 2)
            drawn = [rest[s + i] for s in starts for i in range(period)]
            first = int(rnd.integers(0, period))
            out += list(trend + season + np.array(drawn[first : first + len(part)]))
        want = np.sign(out) * np.expm1(np.abs(out))
        assert found[f"{uid}_MBB{number}"] == pytest.approx(want, abs=0.011, rel=1e-7)


def plain_alignment(a, b):
    """The least cost over all monotone alignments, by recursion over all of them."""
    best = {}

    def cost(i, j):
        if (i, j) not in best:
            before = [cost(x, y) for x, y in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if x >= 0 and y >= 0]
            best[i, j] = (a[i] - b[j]) ** 2 + (min(before) if before else 0.0)
        return best[i, j]

    return cost(len(a) - 1, len(b) - 1)


def soft_cost(a, b, gamma):
    """The soft minimum over all alignments, cell by cell."""
    r = np.full((len(a) + 1, len(b) + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            r[i, j] = (a[i - 1] - b[j - 1]) ** 2 - gamma * np.logaddexp.reduce([-r[i - 1, j - 1] / gamma, -r[i - 1, j] / gamma, -r[i, j - 1] / gamma])
    return r[-1, -1]


def test_alignments_and_gradients():
    draw = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (6, 1), (7, 4), (5, 9)):
        a, b = draw.normal(size=n), draw.normal(size=m)
        way = barycenters.path(a, b)
        assert sum((a[i] - b[j]) ** 2 for i, j in way) == pytest.approx(plain_alignment(a, b))
        assert way[0] == (0, 0) and way[-1] == (n - 1, m - 1) and all((x - u, y - v) in {(0, 1), (1, 0), (1, 1)} for (u, v), (x, y) in itertools.pairwise(way))
        for gamma in (0.1, 1.0):
            step = 1e-5 * np.eye(n)
            want = [(soft_cost(a + e, b, gamma) - soft_cost(a - e, b, gamma)) / 2e-5 for e in step]
            assert barycenters._soft_gradient(a, b, gamma) == pytest.approx(want, rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("kind", ["dtw", "dtw_subgradient", "softdtw"])
def test_barycentre_queries(spark, kind):
    """Each query against loops over single aligned pairs."""
    future = queries.forecasts(spark, SF)[1].toPandas()
    found = series(queries.QUERIES[f"{kind}_barycenter"](spark, SF).toPandas(), "barycenter")
    for uid, g in future.groupby("unique_id"):
        members = [g.sort_values("ds")[m].to_numpy(dtype=float) / 1e6 for m in queries.MODELS]
        mean, before = np.mean(members, axis=0), np.inf
        for _ in range(5):
            if kind == "softdtw":
                h = 1e-6
                slope = [sum((soft_cost(mean + e, s, 0.1) - soft_cost(mean - e, s, 0.1)) / (2 * h) / 3 for s in members) for e in h * np.eye(len(mean))]
                mean = mean - 0.1 * np.array(slope)
                continue
            pairs = [(i, s[j]) for s in members for i, j in barycenters.path(mean, s)]
            cost = sum((mean[i] - v) ** 2 for i, v in pairs) / 3
            if kind == "dtw":
                mean = np.array([np.mean([v for k, v in pairs if k == i]) for i in range(len(mean))])
            else:
                mean = mean - 0.05 * np.array([sum(2 * (mean[i] - v) / 3 for k, v in pairs if k == i) for i in range(len(mean))])
            if abs(before - cost) < 1e-3:
                break
            before = cost
        assert found[uid] == pytest.approx(mean, abs=2e-4 if kind == "softdtw" else 2e-6)


def test_dba_query(spark):
    """Lengths and times are those of the longest series drawn; values lie within the drawn series' range."""
    source, found = panels.month_priority(spark, SF).toPandas(), queries.QUERIES["dba"](spark, SF).toPandas()
    low, high = source.y.min(), source.y.max()
    assert found.unique_id.nunique() == source.unique_id.nunique() and found.y.between(low - 0.01, high + 0.01).all()
    times = {tuple(g.sort_values("ds").ds.astype(str)) for _, g in source.groupby("unique_id")}
    assert all(tuple(g.sort_values("ds").ds) in times for _, g in found.groupby("unique_id"))


def test_kernel_synth_query(spark):
    """Draws have the covariance of their kernels: whitened by it they are the normal numbers that made them."""
    found = series(queries.QUERIES["kernel_synth"](spark, SF).toPandas())
    t, bank = np.linspace(0, 1, 60), synth_arrow.kernel_bank()
    assert all(np.linalg.eigvalsh(k(t, t)).min() > -1e-7 and k(t, t) == pytest.approx(k(t, t).T) for k in bank)
    for n in range(8):
        draw = synth_arrow.generator_of(7, "kernel", n)
        cov = None
        for i in draw.integers(0, len(bank), draw.integers(1, 5)):
            k = bank[i](t, t)
            cov = k if cov is None else cov + k if draw.integers(2) else cov * k
        normal = draw.normal(size=60)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        assert vectors.T @ found[f"KS_UID{n}"] == pytest.approx(np.sqrt(np.clip(values, 0, None)) * normal, abs=1e-3)


def test_ade_gbt_query(spark):
    """Weights from the trees' own expected errors, shared out in plain Python."""
    past = queries.forecasts(spark, SF)[0]
    model = ade.ADE("MS", [1, 2, 3], meta_model=ade.boosted_trees()).fit(past, queries.MODELS)
    expected = {r.unique_id: [abs(r[m]) for m in queries.MODELS] for r in model.meta.predict(ade.last_lags(past, [1, 2, 3])).collect()}
    found = {r.unique_id: [r[m] for m in queries.MODELS] for r in queries.QUERIES["ade_gbt"](spark, SF).collect()}
    assert set(found) == set(expected)
    for uid, e in expected.items():
        share = [(max(e) - x) / (max(e) - min(e)) for x in e]
        assert found[uid] == pytest.approx([x / sum(share) for x in share], abs=1e-6)


# Mixtures where a loss is undefined


def plain_mixture(rows, kind, rule):
    """(weights before the last row's update) of one chain; a row or member without a loss teaches nothing."""

    def loss(f, y):
        if kind == "percentage":
            return abs(f - y) / y if y else None
        return -math.log(f) if f > 0 else None

    m = len(rows[0][1])
    r, b, w = [0.0] * m, 0.0, None
    eta = [math.exp(100 if rule is MLpol else 350)] * m
    for y, f in rows:
        raw = [e * max(x, 0) if rule is MLpol else math.exp(max(-700, min(700, e * x))) for e, x in zip(eta, r, strict=True)]
        w = [1 / m] * m if max(r) <= 0 else [x / sum(raw) for x in raw]
        own = loss(sum(a * x for a, x in zip(w, f, strict=True)), y)
        g = [0.0 if own is None or loss(x, y) is None else own - loss(x, y) for x in f]
        r = [a + x for a, x in zip(r, g, strict=True)]
        if rule is MLpol:
            top = max(b, max(x * x for x in g))
            eta, b = [1 / (1 / e + x * x + top - b) for e, x in zip(eta, g, strict=True)], top
        else:
            eta = [math.sqrt(math.log(m) / (math.log(m) / e**2 + x * x)) for e, x in zip(eta, g, strict=True)]
    return w


@pytest.mark.parametrize("rule", [MLpol, MLewa])
@pytest.mark.parametrize(("kind", "at", "value"), [("percentage", "y", 0.0), ("log", "b", -2.0), ("log", "b", 0.0)])
@pytest.mark.parametrize("where", [0, 5, 11])
def test_undefined_losses(spark, rule, kind, at, value, where):
    draw = random.Random(3)
    rows = [{"unique_id": "s", "ds": dt.datetime(2020, 1, 1 + i), "y": 10 + draw.random(), "a": 10.5, "b": 13 + draw.random(), "c": 8 + draw.random()} for i in range(12)]
    rows[where][at] = value
    fitted = rule(kind, False, weight_by_uid=True).fit(spark.createDataFrame(rows), ["a", "b", "c"])
    want = plain_mixture([(r["y"], (r["a"], r["b"], r["c"])) for r in rows], kind, rule)
    assert list(fitted.weights.first().weights) == pytest.approx(want) and sum(want) == pytest.approx(1)


# Sources and functions


def test_whole_months_follow_the_data(spark, tmp_path):
    """The last month counts if the data reach its last day, and goes otherwise."""
    for last, months in (("2003-03-31 10:00:00", 3), ("2003-03-30 23:00:00", 2), ("2004-02-29 00:00:00", 3)):
        first = pd.Timestamp(last).replace(day=1, hour=0) - pd.DateOffset(months=2)
        days = [*pd.date_range(first, pd.Timestamp(last).normalize() - pd.Timedelta(days=1)), pd.Timestamp(last)]
        pd.DataFrame({"o_orderkey": range(len(days)), "o_orderpriority": "1", "o_totalprice": 1.0, "o_orderdate": np.array(days, "datetime64[us]")}).to_parquet(tmp_path / "orders.parquet")
        assert panels.month_priority(spark, str(tmp_path)).count() == months


def test_smoothing_two_ways(spark, monkeypatch):
    values = np.random.default_rng(4).normal(size=400)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "unique_id string, ds long, y double")
    want = pd.Series(values).ewm(alpha=0.3, adjust=True).mean().to_numpy()
    for fold in (256, 0):
        monkeypatch.setattr(longhorizon, "FOLD", fold)
        assert series(longhorizon.smooth(df, 0.3).toPandas())["s"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("alpha", [0.4, 1.5, 4.0])
def test_gamma_draws(spark, alpha):
    drawn = np.array([r.g for r in spark.range(20_000).select(rng.gamma(1, "g", alpha, F.col("id")).alias("g")).collect()])
    assert (drawn > 0).all() and drawn.mean() == pytest.approx(alpha, rel=0.04) and drawn.var() == pytest.approx(alpha, rel=0.1)
    assert np.mean(drawn < alpha) == pytest.approx(np.mean(np.random.default_rng(0).gamma(alpha, size=200_000) < alpha), abs=0.015)


def test_evaluation_join(spark):
    """Every test row counts once; the test's own value is used; missing forecasts leave a null."""
    day = lambda i: dt.datetime(2020, 1, i)
    test = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), 2.0), ("b", day(1), 0.0)], "unique_id string, ds timestamp, y double")
    given = spark.createDataFrame([("a", day(1), 99.0, 3.0), ("b", day(1), 99.0, 0.0), ("c", day(1), 99.0, 5.0)], "unique_id string, ds timestamp, y double, m double")
    assert sorted((r.unique_id, r.y, r.m) for r in metrics.evaluation_rows(test, given, ["m"]).select("unique_id", "y", F.coalesce("m", F.lit(-1.0)).alias("m")).collect()) == [("a", 1.0, 3.0), ("a", 2.0, -1.0), ("b", 0.0, 0.0)]
    assert {(r.unique_id, r.smape, r.n) for r in metrics.accuracy(test, given, ["m"]).collect()} == {("a", 1.0, 1), ("b", 0.0, 1)}
    both = metrics.compare(given.withColumn("y", F.lit(3.0)), given.withColumn("y", F.col("m")), ["m"]).first()
    assert both.smape_after == 0 and both.gain == both.smape_before > 0


def test_online_weights_do_not_depend_on_batches(spark, tmp_path):
    """Rows of one time, cut between micro-batches, are learned as in one batch."""
    draw, folder = random.Random(5), tmp_path / "in"
    rows = [("s", dt.datetime(2020, 1, 1 + i // 4), i, draw.random() * 10, 3.0, 7.0) for i in range(40)]
    schema = "unique_id string, ds timestamp_ntz, k long, y double, a double, b double"
    found = []
    for cuts in ([40], [7, 22, 40]):
        for i, (a, b) in enumerate(itertools.pairwise([0, *cuts])):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{len(cuts)}/{i}")
        stream, kept = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{len(cuts)}"), []
        weights = online.online_weights(stream, ["a", "b"], tie="k")
        done = weights.writeStream.outputMode("update").foreachBatch(lambda df, i, kept=kept: kept.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c{len(cuts)}").trigger(availableNow=True).start()
        done.awaitTermination()
        last = max(kept, key=lambda r: r.n)
        found.append((last.n, [round(w, 12) for w in last.weights]))
    assert found[0] == found[1] and found[0][0] == 40


def test_shared_folder(spark, monkeypatch):
    """A cluster must name the folder; a session on one machine gets one."""

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = self, self
            self.master, self.found = master, {}

        def get(self, key, default):
            return self.found.get(key, default)

        def set(self, key, value):
            self.found[key] = value

        def setCheckpointDir(self, path):
            pass

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(Session(master))
    local = Session("local[4]")
    assert shared.shared_dir(local) == shared.shared_dir(local) and shared.shared_dir(local).startswith("file:///")
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("make", [lambda: mixture.MLpol("square", True), lambda: mixture.MLewa("absolute", False, which="next"), lambda: mixture.MLpol("percentage", False, trim_ratio=0.5)])
def test_long_chains_are_folded_by_ranges(spark, monkeypatch, make):
    """A global chain cut into ranges ends in the state of one fold, undefined losses, tied times and repeated rows included."""
    rows = [(f"s{u}", t, float((u * 7 + t * 5) % 6), float((t * 3 + u) % 7), float((t + u * 2) % 5 + 1), float((t * 11) % 13)) for u in range(4) for t in range(20)]
    df = spark.createDataFrame(rows + rows[:9], "unique_id string, ds int, y double, a double, b double, c double")
    whole = make().fit(df, ["a", "b", "c"])
    monkeypatch.setattr(mixture, "CHAIN", 12)
    parts = make().fit(df.repartition(6), ["a", "b", "c"])
    assert parts.state.first().state == whole.state.first().state
    assert sorted(parts.weights.collect()) == sorted(whole.weights.collect())
