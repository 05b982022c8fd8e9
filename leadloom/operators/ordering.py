"""Explicit order: first per key, top-n per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[Column | str]


def top_per_key(df: DataFrame, keys: Cols, order: Cols, n: int | None = 1, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in a total order (``None``: all rows, with their rank).

    The rank filter lets Spark keep at most ``n`` rows per key in every map task before
    the shuffle (WindowGroupLimit), so a key holding a large share of all rows stays cheap.
    """
    name = rank_col or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window))
    out = ranked if n is None else ranked.filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def first_per_key(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def join_sparse(df: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """Left join to a one-row-per-key table where many left keys may be null.

    Null keys match nothing but would all land in one shuffle partition; a salt spreads them.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not _is_map(df, c)]), F.lit(buckets)) + 1
    salted = df.withColumn("_salt", F.when(complete, F.lit(0).cast("bigint")).otherwise(spread))
    return salted.join(right.withColumn("_salt", F.lit(0).cast("bigint")), [*keys, "_salt"], "left").drop("_salt")


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def first_value(c: Column, order: Column) -> Column:
    """First non-null value of a column in the given order (an aggregate)."""
    return F.min_by(c, F.when(c.isNotNull(), order))
