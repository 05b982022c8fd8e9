"""Row shaping that evaluates an expensive expression once.

A plain ``explode`` makes the optimizer add a non-empty test, and a filter on a derived column is
moved below the projection; both repeat the whole expression. Generated columns stop that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(
    df: DataFrame, array: Column | str, item: str, keep: Sequence[str | Column] | None = None, pos: str | None = None
) -> DataFrame:
    """One row per element; rows with an empty or null array disappear."""
    kept = list(keep) if keep is not None else [F.col(c) for c in df.columns]
    arr = F.col(array) if isinstance(array, str) else array
    rows = df.select(*kept, F.posexplode_outer(arr).alias(pos or "_pos", item))
    present = rows.filter(F.col(pos or "_pos").isNotNull())
    return present if pos else present.drop("_pos")


def with_checked(df: DataFrame, name: str, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """Add a column and keep the rows whose value passes the test."""
    passing = F.filter(F.array(value), lambda v: v.isNotNull() & test(v))
    return unnest(df, passing, name)
