"""Elementwise and array transformations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def total(values: Column) -> Column:
    """The sum of an array, first to last; null counts as nothing."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def min_max(values: Column) -> Column:
    """(x - min) / (max - min) of an array's elements; all zero where they are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.when(x.isNotNull(), F.lit(0.0))))


def proportion(values: Column) -> Column:
    """Elements over their sum, null where that is zero."""
    return let(total(values), lambda s: F.transform(values, lambda x: F.try_divide(x, s)))


def normalize_and_proportion(values: Column) -> Column:
    return let(min_max(values), proportion)


def reach(alpha: float) -> int:
    """How many values an exponentially weighted mean has to see: weights of older ones are below 1e-20 of the newest."""
    return 1 if alpha >= 1 else math.ceil(math.log(1e-20) / math.log(1 - alpha))


def ewm(values: Column, alpha: float) -> Column:
    """The exponentially weighted mean of an array up to its end, weights summing to one over what is there."""
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    step = lambda s, x: F.struct((x + (1 - alpha) * s.num).alias("num"), (1 + (1 - alpha) * s.den).alias("den"))
    return F.aggregate(values, zero, step, lambda s: s.num / s.den)
