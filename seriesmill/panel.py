"""The panel contract: a series id, a time and a target, one row a pair of id and time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that are never member forecasts when members are inferred.
METADATA = ("unique_id", "ds", "y", "h", "cutoff", "horizon")


@dataclass(frozen=True)
class Names:
    """The names of a panel's columns."""

    id: str = "unique_id"
    time: str = "ds"
    target: str = "y"


DEFAULT = Names()


def check_schema(df: DataFrame, names: Names = DEFAULT, target: bool = True) -> DataFrame:
    """``df`` itself, if its id is a string and its target a number; looks at the schema only."""
    kinds = {f.name: f.dataType for f in df.schema}
    for needed in (names.id, names.time, *([names.target] if target else [])):
        if needed not in kinds:
            raise ValueError(f"column {needed!r} is missing")
    if not isinstance(kinds[names.id], T.StringType):
        raise TypeError(f"{names.id!r} must be a string")
    if target and not isinstance(kinds[names.target], T.NumericType):
        raise TypeError(f"{names.target!r} must be numeric")
    return df


def check_panel(df: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """check_schema, and one row a pair of id and time; runs one aggregation."""
    check_schema(df, names)
    if not df.groupBy(names.id, names.time).count().where("count > 1").isEmpty():
        raise ValueError("a series has more than one row at a time")
    return df


def member_names(df: DataFrame, models: list[str] | None = None, names: Names = DEFAULT) -> list[str]:
    """The given members, or all columns that are not metadata."""
    if models is not None:
        if missing := [m for m in models if m not in df.columns]:
            raise ValueError(f"no forecasts of {', '.join(missing)}")
        return list(models)
    return [c for c in df.columns if c not in (*METADATA, names.id, names.time, names.target)]


def whole_members(df: DataFrame, models: list[str], na: str) -> DataFrame:
    """``na`` 'drop': rows without a value or a member's forecast go; 'error': such a row stops the query."""
    holes = F.lit(False)
    for c in models:
        holes = holes | F.col(c).isNull() | F.isnan(c)
    if na == "drop":
        return df.where(~holes)
    if na == "error":
        return df.where(F.when(holes, F.raise_error(F.lit("a member's forecast is missing")).cast("boolean")).otherwise(True))
    raise ValueError("na must be 'drop' or 'error'")


def with_times(df: DataFrame, names: Names = DEFAULT, pattern: str | None = None) -> DataFrame:
    """``df`` with its times, given as text, as timestamps without a zone; text that is none is an error."""
    return df.withColumn(names.time, F.to_timestamp_ntz(names.time, *([] if pattern is None else [F.lit(pattern)])))
