"""Current states: of the rows of one key, the one that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(df: DataFrame, key: Column, seen: str, tie: str, columns: dict[str, Column]) -> DataFrame:
    """One row ``(key, *columns)`` per key: that with the latest `seen`, among equals with the lowest `tie`.

    Rows with a null key are left out; a null `seen` is older than any time. One shuffle with map-side combining carries only `columns`,
    so a key that holds a large part of all rows costs no more than any other. Other columns of `df` don't matter, whatever their names.
    """
    picked = df.select(key.alias("key"), F.struct(F.col(seen).alias("s"), (-F.col(tie)).alias("t")).alias("at"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row"))
    best = picked.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("row", "at").alias("row"))
    return best.select("key", "row.*")
