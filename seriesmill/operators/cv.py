"""Splits and horizons of cross-validated forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train_test_split(df: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """All but the last ``horizon`` rows of each series, and those."""
    rank = F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))
    marked = df.withColumn("__rank", rank)
    return marked.where(F.col("__rank") > horizon).drop("__rank"), marked.where(F.col("__rank") <= horizon).drop("__rank")


def _origin(df: DataFrame) -> list[str]:
    return ["unique_id", "cutoff"] if "cutoff" in df.columns else ["unique_id"]


def get_horizon(df: DataFrame) -> DataFrame:
    """Adds ``horizon``, a row's number by time within its series and cutoff, from 1."""
    if "horizon" in df.columns:
        raise ValueError("there is a column named horizon")
    return df.withColumn("horizon", F.row_number().over(W.partitionBy(*_origin(df)).orderBy("ds")))


def first_steps(df: DataFrame) -> DataFrame:
    """The first row of each series and cutoff, without the cutoff."""
    rank = F.row_number().over(W.partitionBy(*_origin(df)).orderBy("ds"))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "cutoff")


def n_windows(df: DataFrame, n_lags: int, horizon: int) -> DataFrame:
    """One row: how many cross-validation windows the shortest series allows."""
    short = df.groupBy("unique_id").count().agg(F.min("count").alias("n"))
    return short.select(F.floor((F.col("n") - n_lags - horizon) / 2).cast("long").alias("n_windows"))


def dense_grid(df: DataFrame) -> DataFrame:
    """Rows of every series at 0..max(ds), ``ds`` being positions; missing ones have y 0 and y_mask 0."""
    top = df.agg(F.max("ds").alias("top"))
    grid = df.select("unique_id").distinct().crossJoin(F.broadcast(top)).select("unique_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("ds"))
    joined = grid.join(df.select("unique_id", F.col("ds").cast("long").alias("ds"), "y"), ["unique_id", "ds"], "left")
    return joined.select("unique_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"), F.col("y").isNotNull().cast("int").alias("y_mask"))
