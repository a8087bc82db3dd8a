"""Augmentation of micro-batches, batch arrays, and stateful mixtures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesmill.operators.cv import dense_grid
from seriesmill.operators.synth import Generator


def batch_to_panel(batch: DataFrame) -> DataFrame:
    """(position, y array, y_mask array) to a panel with ids ID{position} and ds the place in the array, masked places left out."""
    if set(batch.columns) != {"position", "y", "y_mask"}:
        raise ValueError("a batch has the columns position, y and y_mask")
    rows = batch.select(F.concat(F.lit("ID"), F.col("position").cast("string")).alias("unique_id"), F.posexplode(F.arrays_zip("y", "y_mask")).alias("ds", "r"))
    return rows.where(F.col("r.y_mask") > 0).select("unique_id", F.col("ds").cast("long").alias("ds"), F.col("r.y").cast("double").alias("y"))


def panel_to_batch(panel: DataFrame) -> DataFrame:
    """One row a series of a panel with positions as times: unique_id, y, y_mask as float arrays over the whole grid."""
    rows = dense_grid(panel).groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y", "y_mask"))).alias("r"))
    return rows.select("unique_id", F.transform("r", lambda x: x.y.cast("float")).alias("y"), F.transform("r", lambda x: x.y_mask.cast("float")).alias("y_mask"))


class OnlineAugmentation:
    """Adds synthetic series to each training batch, and to validation batches if told to.

    Of several generators a batch takes one by the hash of its number. Only
    generators of a series from another fit: those without an input are refused.
    """

    def __init__(self, generator: Generator | list[Generator], augment_on_valid: bool = False):
        self.generators = generator if isinstance(generator, list) else [generator]
        if not self.generators or not all(isinstance(g, Generator) for g in self.generators):
            raise TypeError("generators must make series from series")
        self.augment_on_valid = augment_on_valid

    def pick(self, batch_id: int) -> Generator:
        return self.generators[(batch_id * 2654435761 % (1 << 32)) % len(self.generators)]

    def __call__(self, panel: DataFrame, batch_id: int = 0, valid: bool = False) -> DataFrame:
        if valid and not self.augment_on_valid:
            return panel
        return self.pick(batch_id).augment(panel)

    def augment_batch(self, batch: DataFrame, batch_id: int = 0) -> DataFrame:
        """Arrays in, arrays with the synthetic series out."""
        return panel_to_batch(self(batch_to_panel(batch), batch_id))

    def write(self, stream: DataFrame, path: str, checkpoint: str):
        """Starts a query that writes each micro-batch, augmented, under its number; a repeated batch replaces itself."""

        def each(df: DataFrame, batch_id: int) -> None:
            self(df, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_weights(stream: DataFrame, models: list[str], kind: str = "mlpol", tie: str | None = None) -> DataFrame:
    """A series' mixture weights after each micro-batch, from squared gradient losses learned as rows come.

    Rows are learned in the order of ``ds``, then of ``tie``, a whole number that
    tells rows of one time apart where a series has such. State is one row a
    series: regrets, rates and the last time and tie learned; rows at or before
    them came late and are left out, so weights depend on the order of rows and
    not on how they fall into batches. In order, the weights are those of the
    batch fold after its last row.
    """
    m = len(models)
    state = "r array<double>, eta array<double>, b double, ds timestamp_ntz, tie long, n long"
    out = "unique_id string, ds timestamp_ntz, n long, weights array<double>"
    first = math.exp(100 if kind == "mlpol" else 350)

    def weights(r: np.ndarray, eta: np.ndarray) -> np.ndarray:
        if r.max() <= 0:
            return np.full(m, 1 / m)
        raw = eta * np.maximum(r, 0) if kind == "mlpol" else np.clip(np.exp(eta * r), math.exp(-700), math.exp(700))
        return raw / raw.sum()

    def learn(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        r, eta, b, last, seen, n = held.get if held.exists else ([0.0] * m, [first] * m, 0.0, None, 0, 0)
        r, eta = np.array(r), np.array(eta)
        rows = pd.concat(list(frames)).sort_values(["ds", "__tie"], kind="stable")
        if last is not None:
            rows = rows[(rows["ds"] > last) | ((rows["ds"] == last) & (rows["__tie"] > seen))]
        rows = rows.dropna(subset=["y", *models])
        for row in rows.drop(columns="__tie").itertuples(index=False):
            f = np.array([getattr(row, c) for c in models], dtype=float)
            w = weights(r, eta)
            fc = float((w / w.sum() * f).sum())
            loss = 2 * (fc - row.y) * fc - 2 * (fc - row.y) * f
            r = r + loss
            if kind == "mlpol":
                top = max(b, float((loss * loss).max()))
                eta, b = 1 / (1 / eta + loss * loss + top - b), top
            else:
                eta = np.sqrt(math.log(m) / (math.log(m) / (eta * eta) + loss * loss))
            last, n = row.ds, n + 1
        if len(rows):
            seen = int(rows["__tie"].iloc[-1])
        if last is not None:
            held.update((r.tolist(), eta.tolist(), b, last, seen, n))
            yield pd.DataFrame({"unique_id": [key[0]], "ds": [last], "n": [n], "weights": [weights(r, eta).tolist()]})

    stream = stream.withColumn("__tie", F.lit(0).cast("long") if tie is None else F.col(tie).cast("long"))
    return stream.groupBy("unique_id").applyInPandasWithState(learn, out, state, "update", GroupStateTimeout.NoTimeout)
