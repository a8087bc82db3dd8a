"""From scores to convex weights, and from weights to combined forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions import metrics
from seriesmill.functions.transforms import let, normalize_and_proportion, total

#: Rows of a scoring window by frequency alias.
WINDOW_BY_FREQ = {"H": 48, "D": 14, "W": 16, "M": 12, "ME": 12, "MS": 12, "Q": 4, "QS": 4, "Y": 6}
#: Further aliases of the same frequencies.
ALIASES = {"h": "H", "QE": "Q", "YE": "Y", "YS": "Y"}


def window_size(freq: str, size: int | None = None) -> int:
    if size is not None:
        return size
    key = ALIASES.get(freq, freq)
    if key not in WINDOW_BY_FREQ:
        raise ValueError(f"no window size is known for frequency {freq!r}; give one")
    return WINDOW_BY_FREQ[key]


def n_kept(trim_ratio: float, n_models: int) -> int:
    """How many members a trim ratio keeps: truncated, one at least."""
    return max(int(trim_ratio * n_models), 1)


def last_rows(df: DataFrame, n: int, id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
    """The last ``n`` rows of each series by time."""
    order = W.partitionBy(id_col).orderBy(F.desc(time_col))
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def model_scores(df: DataFrame, models: list[str], window: int | None = None) -> DataFrame:
    """(unique_id, scores): each member's SMAPE in the order of ``models``, over the last ``window`` rows if given."""
    rows = df if window is None else last_rows(df, window)
    wide = metrics.scores_by_series(rows, models, ["unique_id"])
    return wide.select("unique_id", F.array(*[F.col(m) for m in models]).alias("scores"))


def ranked(scores: Column, k: int) -> Column:
    """Ordinals of the ``k`` smallest scores; null last, ties to the earlier member."""
    keyed = F.transform(scores, lambda x, i: F.struct(x.isNull().alias("none"), x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s.i)


def global_scores(scores: DataFrame, n_models: int) -> DataFrame:
    """One row: each member's mean score over series."""
    return scores.agg(F.array(*[F.avg(F.element_at("scores", i + 1)) for i in range(n_models)]).alias("mean_scores"))


def trimmed(weights: Column, keep: Column, degenerate: str) -> Column:
    """Zeroes members outside ``keep`` and scales the rest to one.

    Where nothing is left of the weights, ``degenerate`` decides: 'zero' gives
    zeros, 'equal' equal shares of the kept members, 'null' nulls.
    """
    kept = F.transform(weights, lambda w, i: F.when(F.array_contains(keep, i), w).otherwise(F.lit(0.0)))

    def scale(s: Column) -> Column:
        even = F.transform(weights, lambda w, i: F.when(F.array_contains(keep, i), 1.0 / F.size(keep)).otherwise(F.lit(0.0)))
        none = {"zero": F.transform(weights, lambda w: F.lit(0.0)), "equal": even, "null": F.transform(weights, lambda w: F.lit(None).cast("double"))}[degenerate]
        return F.when(s > 0, F.transform(kept, lambda w: F.coalesce(w, F.lit(0.0)) / s)).otherwise(none)

    return let(total(kept), scale)


def score_weights(scores: DataFrame, n_models: int, k: int, by_uid: bool, degenerate: str = "zero") -> DataFrame:
    """(unique_id, weights): min-max of the negated scores as proportions, trimmed to the best ``k``.

    The best are found for each series or, by mean score, for all; the latter
    are one row, joined to all.
    """
    if by_uid:
        keyed = scores.withColumn("keep", ranked(F.col("scores"), k))
    else:
        keyed = scores.crossJoin(F.broadcast(global_scores(scores, n_models).select(ranked(F.col("mean_scores"), k).alias("keep"))))
    shares = normalize_and_proportion(F.transform("scores", lambda x: -x))
    return keyed.select("unique_id", trimmed(shares, F.col("keep"), degenerate).alias("weights"))


def wide(weights: DataFrame, models: list[str]) -> DataFrame:
    """One column a member instead of the array."""
    return weights.select("unique_id", *[F.element_at("weights", i + 1).alias(m) for i, m in enumerate(models)])


def combine(forecasts: DataFrame, weights: DataFrame, models: list[str], name: str, on_missing: str = "error", renormalise: bool = False) -> DataFrame:
    """Adds ``name``, the weighted sum of members.

    A null forecast adds nothing, and the other weights stay as they are unless
    ``renormalise``. A series without weights is an error, null, or the mean
    ('equal'), as ``on_missing`` says.
    """
    joined = forecasts.join(weights.select("unique_id", F.col("weights").alias("__w")), "unique_id", "left")
    values = F.array(*[F.col(m) for m in models])
    products = F.zip_with(values, "__w", lambda f, w: f * w)
    out = total(products)
    if renormalise:
        out = F.try_divide(out, total(F.zip_with(values, "__w", lambda f, w: F.when(f.isNotNull(), w))))
    missing = {"error": F.raise_error(F.concat(F.lit("no weights for series "), F.coalesce("unique_id", F.lit("null")))).cast("double"), "null": F.lit(None).cast("double"), "equal": F.try_divide(total(values), F.lit(float(len(models))))}[on_missing]
    return joined.withColumn(name, F.when(F.col("__w").isNull(), missing).otherwise(out)).drop("__w")
