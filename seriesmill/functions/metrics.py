"""Accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smape_term(y: Column, f: Column) -> Column:
    """|y - f| / (|y| + |f|), zero where both are zero, null where either is null."""
    both = F.abs(y) + F.abs(f)
    return F.when(both == 0, F.lit(0.0)).otherwise(F.abs(y - f) / both)


def smape(y: Column, f: Column, scale: float = 2.0) -> Column:
    """Symmetric mean absolute percentage error as an aggregate; ``scale`` is 2 or 200. Null forecasts are left out."""
    return F.lit(scale) * F.avg(smape_term(y, f))


def scores_by_series(forecasts: DataFrame, models: list[str], by: list[str], y: str = "y", scale: float = 2.0) -> DataFrame:
    """One row a group with each model's SMAPE; partial sums are formed before the shuffle."""
    return forecasts.groupBy(*by).agg(*[smape(F.col(y), F.col(m), scale).alias(m) for m in models])


def evaluation_rows(test: DataFrame, forecasts: DataFrame, models: list[str], group: str | None = None) -> DataFrame:
    """Every row of ``test`` (unique_id, ds, y) with the members' forecasts for it, null where there is none.

    ``group`` is a further column of either table to score by. A value that
    ``forecasts`` holds is not read: the test's own counts.
    """
    here = [c for c in ("unique_id", "ds", "y", group) if c in test.columns]
    there = [c for c in ("unique_id", "ds", *models, group) if c in forecasts.columns and c not in here[2:]]
    return test.select(*here).join(forecasts.select(*there), ["unique_id", "ds"], "left")


def accuracy(test: DataFrame, forecasts: DataFrame, models: list[str], by: list[str] | None = None, scale: float = 2.0) -> DataFrame:
    """(by, model, smape, n): each member's SMAPE over the test rows that it has a forecast for, and their number."""
    by = ["unique_id"] if by is None else by
    group = next((c for c in by if c not in ("unique_id", "ds")), None)
    long = evaluation_rows(test, forecasts, models, group).unpivot([*by, "y"], models, "model", "f")
    return long.groupBy(*by, "model").agg(smape(F.col("y"), F.col("f"), scale).alias("smape"), F.count("f").alias("n"))


def compare(before: DataFrame, after: DataFrame, models: list[str], scale: float = 2.0) -> DataFrame:
    """(model, smape_before, smape_after, gain) over series, of forecasts without and with augmentation; rows have y."""
    tables = [leaderboard(x, models, scale=scale).select("model", F.col("mean_smape").alias(name)) for x, name in ((before, "smape_before"), (after, "smape_after"))]
    return tables[0].join(tables[1], "model").withColumn("gain", F.col("smape_before") - F.col("smape_after"))


def leaderboard(forecasts: DataFrame, models: list[str], id_col: str = "unique_id", y: str = "y", scale: float = 2.0) -> DataFrame:
    """(model, mean_smape, median_smape) over series, best first."""
    long = scores_by_series(forecasts, models, [id_col], y, scale).unpivot([id_col], models, "model", "smape")
    return long.groupBy("model").agg(F.avg("smape").alias("mean_smape"), F.percentile("smape", 0.5).alias("median_smape")).orderBy("mean_smape", "model")
