"""Joins of rows, whose keys may be hot, with a table that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_KEYS = 50_000  # keys up to which their table goes to the workers; more are joined by shuffle
HOT_ROWS = 1_000_000  # rows of one key that one task still takes; keys of more go to the workers, at most rows / HOT_ROWS of them


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", *, bound: int | None = BROADCAST_KEYS, hot: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keys`` (each key once) such that no hot key's rows meet in one task.

    A table of at most ``bound`` keys is broadcast; ``keys`` should be written
    then, as it is counted first, and ``None`` leaves that out.  Otherwise only
    the keys with more than ``hot`` rows are broadcast, and their rows stay
    where they are; all others are joined by shuffle.  ``counted`` may give the
    rows of each key as ``(keys, n)``.  All ways give the same rows.
    """
    if bound is not None and keys.count() <= bound:
        return rows.join(F.broadcast(keys), on, how)
    if counted is None:
        counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast(counted.where(F.col("n") > hot).select(*on))
    own = F.broadcast(keys.join(heavy, on, "left_semi"))
    return rows.join(heavy, on, "left_anti").join(keys, on, how).unionByName(rows.join(heavy, on, "left_semi").join(own, on, how))
