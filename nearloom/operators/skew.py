"""Joins whose left side may hold a large share of its rows under one key.

Counting keys reads the left side once more, so these joins are for sides that are written
tables or whose counts are known. A side that is the output of a k-NN join meets the other with
a plain sort-merge join, whose hot partitions adaptive execution splits at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above this many rows.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of pieces to split them into.

    Counts are combined before the shuffle. Every such key is named, at most one for each
    ``hot_rows`` rows of ``df``; joins with them leave it to the planner whether to broadcast.
    """
    return (
        df.groupBy(*keys)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(*keys, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("pieces"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: str | list[str],
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Equi-join that spreads the ``hot`` keys of ``left`` by a hash of the columns ``spread``.

    The right side's rows of a hot key are repeated once per piece; all other rows are sent once.
    The result equals the plain join. ``hot`` is ``keys, pieces``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    spread = [spread] if isinstance(spread, str) else spread
    pieces = F.coalesce("pieces", F.lit(1))
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int")
    ).drop("pieces")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), pieces - 1))
    ).drop("pieces")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def split_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """Inner equi-join that leaves ``right`` where it lies.

    For a ``right`` that is bucketed by the keys and holds a bounded number of rows per key. Hot
    keys of ``left`` meet copies of their few right rows in pieces; all other rows are shuffled
    to the buckets. The result equals the plain join. ``hot`` is ``keys, pieces`` where it is known.
    """
    hot = hot_keys(left, keys, hot_rows) if hot is None else hot
    cold = left.join(hot, keys, "left_anti").join(right, keys)
    hot_left, hot_right = (side.join(hot, keys, "left_semi") for side in (left, right))
    return cold.unionByName(salted_join(hot_left, hot_right, keys, left.columns, hot))
