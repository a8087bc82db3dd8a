"""Online mixtures by regret: polynomial and exponential weights."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.losses import expert_loss
from seriesmill.functions.transforms import let, total
from seriesmill.operators import weighting
from seriesmill.operators.ensembles import Ensemble
from seriesmill.panel import whole_members
from seriesmill.shared import shared_dir

CHAIN = 1 << 18  # rows of a global chain that one task folds


class Mixture(Ensemble):
    """Weights that follow each member's regret row by row.

    One chain over all rows in the order of (ds, unique_id), or with
    ``weight_by_uid`` one for each series in the order of ds. A chain is a fold
    over an ordered array of narrow rows, inside the JVM. A global chain is
    serial by its definition; one of more than CHAIN rows is cut into ranges of
    (ds, unique_id) in the shared folder, folded one after the other with the
    state, a few numbers a member, handed on. ``which`` 'last' uses the weights before the last
    row's update, 'next' those after it. Rows with a missing value or forecast
    are dropped or, with ``na`` 'error', refused. Where a loss is undefined (a
    percentage of zero, the log of a forecast that is not positive) a member has
    no regret, so such a row says nothing of it and spoils nothing.
    """

    def __init__(self, loss_type: str, gradient: bool, weight_by_uid: bool = False, trim_ratio: float = 1.0, which: str = "last", na: str = "drop", tau: float = 0.5):
        super().__init__(trim_ratio)
        self.loss = expert_loss(loss_type, gradient, tau)
        if which not in ("last", "next"):
            raise ValueError("which must be 'last' or 'next'")
        self.by_uid, self.which, self.na = weight_by_uid, which, na

    def _fit(self, insample: DataFrame) -> None:
        m = len(self.models)
        rows = whole_members(insample, [*self.models, "y"], self.na)
        row = F.struct("ds", "unique_id", F.col("y").cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in self.models]).alias("f"))
        keys = ["unique_id"] if self.by_uid else []
        if self.by_uid or (count := rows.count()) <= CHAIN:
            chains = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
            self.state = chains.withColumn("state", F.aggregate("rows", self._start(m), self._step)).drop("rows")
        else:
            self.state = self._by_ranges(rows.select(row.alias("row")), -(-count // CHAIN) + 1, m)
        w = F.col("state.w") if self.which == "last" else self._weights(F.col("state"), m)
        found = self.state.select(*keys, w.alias("weights"))
        if not self.by_uid:
            found = insample.select("unique_id").distinct().crossJoin(F.broadcast(found))
        if self.trim_ratio < 1:
            worst = found.withColumn("scores", F.transform("weights", lambda x: -x))
            if self.by_uid:
                keyed = worst.withColumn("keep", weighting.ranked(F.col("scores"), self.kept))
            else:
                best = weighting.global_scores(worst, m).select(weighting.ranked(F.col("mean_scores"), self.kept).alias("keep"))
                keyed = worst.crossJoin(F.broadcast(best))
            found = keyed.select("unique_id", weighting.trimmed(F.col("weights"), F.col("keep"), "zero").alias("weights"))
        self.weights = found.select("unique_id", "weights")

    def _by_ranges(self, rows: DataFrame, ranges: int, m: int) -> DataFrame:
        spark = rows.sparkSession
        path = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(ranges, "row.ds", "row.unique_id").withColumn("__range", F.spark_partition_id())
        dealt.write.partitionBy("__range").parquet(path)
        dealt, state = spark.read.schema(dealt.schema).parquet(path), self._start(m)
        for n in range(ranges):
            part = dealt.where(F.col("__range") == n).agg(F.array_sort(F.collect_list("row")).alias("rows"))
            found = part.select(F.aggregate("rows", state, self._step).alias("state")).first().state
            held = [F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value) for value in found]
            state = F.struct(*[value.alias(name) for name, value in zip(found.__fields__, held, strict=True)])
        return spark.range(1).select(state.alias("state"))

    def _start(self, m: int) -> Column:
        fill = lambda x: F.array(*[F.lit(x)] * m)
        return F.struct(fill(0.0).alias("r"), fill(self.first_rate).alias("eta"), F.lit(0.0).alias("b"), fill(1.0 / m).alias("w"))

    def _weights(self, state: Column, m: int) -> Column:
        raw = self._raw(state)
        return F.when(F.array_max(state.r) <= 0, F.transform(state.r, lambda _: F.lit(1.0 / m))).otherwise(let(total(raw), lambda s: F.transform(raw, lambda x: x / s)))

    def _step(self, state: Column, row: Column) -> Column:
        m = len(self.models)

        def with_weights(w: Column) -> Column:
            mixed = let(total(w), lambda s: total(F.zip_with(w, row.f, lambda a, b: a / s * b)))

            def with_forecast(fc: Column) -> Column:
                own = self.loss(fc, row.y, fc)
                regret = F.transform(row.f, lambda f: F.coalesce(own - self.loss(f, row.y, fc), F.lit(0.0)))

                def with_regret(r: Column) -> Column:
                    b, eta = self._rate(state, r, m)
                    return F.struct(F.zip_with(state.r, r, lambda a, x: a + x).alias("r"), eta.alias("eta"), b.alias("b"), w.alias("w"))

                return let(regret, with_regret)

            return let(mixed, with_forecast)

        return let(self._weights(state, m), with_weights)


class MLpol(Mixture):
    """Polynomially weighted average with a learning rate for each member."""

    alias, first_rate = "MLpol", math.exp(100)

    def _raw(self, state: Column) -> Column:
        return F.zip_with(state.eta, state.r, lambda e, r: e * F.greatest(r, F.lit(0.0)))

    def _rate(self, state: Column, r: Column, m: int) -> tuple[Column, Column]:
        b = F.greatest(state.b, F.array_max(F.transform(r, lambda x: x * x)))
        return b, F.zip_with(state.eta, r, lambda e, x: 1 / (1 / e + x * x + b - state.b))


class MLewa(Mixture):
    """Exponentially weighted average with a learning rate for each member."""

    alias, first_rate = "MLewa", math.exp(350)

    def _raw(self, state: Column) -> Column:
        low, high = F.lit(math.exp(-700)), F.lit(math.exp(700))
        return F.zip_with(state.eta, state.r, lambda e, r: F.greatest(F.least(F.exp(e * r), high), low))

    def _rate(self, state: Column, r: Column, m: int) -> tuple[Column, Column]:
        log_m = math.log(m)
        return state.b, F.zip_with(state.eta, r, lambda e, x: F.sqrt(F.try_divide(F.lit(log_m), log_m / (e * e) + x * x)))
