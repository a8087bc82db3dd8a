"""Panels over the order, line item and event tables, and baseline member forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.transforms import ewm, reach


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(column: str) -> F.Column:
    """A sum of cents, exact in any order, as double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def month(column: str) -> F.Column:
    return F.trunc(F.col(column), "MM")


def whole_months(rows: DataFrame, column: str) -> DataFrame:
    """The rows of whole months: those of the last one go unless they reach its last day, by the table's own largest time."""
    end = rows.agg(F.trunc(F.date_add(F.max(column).cast("date"), 1), "MM").cast("timestamp_ntz").alias("__end"))
    return rows.join(F.broadcast(end), F.col(column) < F.col("__end")).drop("__end")


def month_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by priority, whole months only."""
    orders = whole_months(read(spark, sf_dir, "orders"), "o_orderdate")
    return orders.groupBy(F.col("o_orderpriority").alias("unique_id"), month("o_orderdate").alias("ds")).agg(exact_sum("o_totalprice").alias("y"))


def month_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by the customer's nation. Orders are summed by customer before the join."""
    orders = whole_months(read(spark, sf_dir, "orders"), "o_orderdate")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    small = orders.groupBy("o_custkey", month("o_orderdate").alias("ds")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("part"))
    joined = small.join(customers, "o_custkey")
    return joined.groupBy(F.col("c_nationkey").cast("string").alias("unique_id"), "ds").agg(F.sum("part").cast("double").alias("y"))


def month_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly line item value by return flag and status."""
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(F.concat("l_returnflag", "l_linestatus").alias("unique_id"), month("l_shipdate").alias("ds")).agg(exact_sum("l_extendedprice").alias("y"))


def hour_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by type; hours without events have no row."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), hour.alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))


def members(panel: DataFrame, season: int = 12) -> DataFrame:
    """Adds strictly past forecasts; rows before a full season go.

    naive, ma3, snaive, drift, mean, the exponentially weighted mean and a line
    in the value before, fitted to the rows before by least squares.

    All windows share one ordering, thus one shuffle by series.
    """
    w = W.partitionBy("unique_id").orderBy("ds")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    n, first, last = F.row_number().over(w), F.first("y").over(past), F.lag("y", 1).over(w)
    slope, level = F.regr_slope("y", "__x").over(past), F.regr_intercept("y", "__x").over(past)
    out = panel.withColumn("__x", F.lag("y", 1).over(w)).select(
        "unique_id",
        "ds",
        "y",
        last.alias("naive"),
        ((F.lag("y", 1).over(w) + F.lag("y", 2).over(w) + F.lag("y", 3).over(w)) / 3).alias("ma3"),
        F.lag("y", season).over(w).alias("snaive"),
        F.when(n > 2, last + (last - first) / F.greatest(n - 2, F.lit(1))).alias("drift"),
        F.avg("y").over(past).alias("mean"),
        ewm(F.collect_list("y").over(w.rowsBetween(-reach(0.3), -1)), 0.3).alias("ewm"),
        (level + slope * last).alias("ols"),
        n.alias("n"),
    )
    return out.where(F.col("n") > season).drop("n")
