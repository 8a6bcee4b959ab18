"""Ordered collections of articles: rows with a position `pos`, and what is done with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_column(corpus: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """A column from `values(pos, value)` by position; positions that differ raise an error when the result is computed."""
    v = values.select(F.col("pos").alias("_pos"), F.col("value").alias("_value"))
    both = corpus.join(v, F.col("pos") == F.col("_pos"), "full")
    same = F.col("pos").isNull() | F.col("_pos").isNull()
    checked = F.when(same, F.raise_error(F.lit("both must have the same positions")).cast("string")).otherwise(F.lit(None).cast("string"))
    return both.where(checked.isNull()).select(*[corpus[c] for c in corpus.columns if c != name], F.col("_value").alias(name))


def apply(corpus: DataFrame, column: str, f: Callable[[Column], Column], into: str | None = None) -> DataFrame:
    return corpus.withColumn(into or column, f(F.col(column)))


def filtered(corpus: DataFrame, column: str, f: Callable[[Column], Column]) -> DataFrame:
    """Rows that satisfy the predicate, renumbered from 0 in the old order."""
    return renumbered(corpus.where(f(F.col(column))), F.col("pos"))


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of both, the second behind the first; columns that one lacks are null."""
    n = first.agg(F.max("pos")).first()[0]
    return first.unionByName(second.withColumn("pos", F.col("pos") + F.lit(0 if n is None else n + 1)), allowMissingColumns=True)


def as_text(title: Column, body: Column, times: int = 1) -> Column:
    """Title and body with a space between, the title `times` times."""
    return F.concat(*[F.coalesce(title, F.lit("")), F.lit(" ")] * times, F.coalesce(body, F.lit("")))


def ranked(rows: DataFrame, key: Column, parts: int = 4096) -> DataFrame:
    """Adds `rank`, from 0, by a hexadecimal text key, ties by `pos`, without sorting everything in one task.

    Rows are numbered within the buckets of the key's first digits; the buckets' sizes, at most 4096 numbers, give where each begins.
    """
    digits = max(1, (parts - 1).bit_length() // 4)
    with_bucket = rows.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, digits))
    sizes = with_bucket.groupBy(F.col("_b").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_of", before.alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "pos")) - 1
    return with_bucket.join(starts, F.col("_b") == F.col("_of")).withColumn("rank", (F.col("_start") + inside).cast("bigint")).drop("_k", "_b", "_of", "_start")


def shuffled(corpus: DataFrame, seed: int) -> DataFrame:
    """The same rows in an order fixed by the seed; `pos` is the new place."""
    return ranked(corpus, F.md5(F.concat(F.lit(f"{seed}-"), F.col("pos").cast("string")))).withColumn("pos", F.col("rank")).drop("rank")


def split(corpus: DataFrame, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts in the old order, chosen by the seed; the first has the ratio's share, at least one row and at most all but one."""
    n = corpus.count()
    first = min(max(int(n * ratio), 1), max(n - 1, 0))
    r = ranked(corpus, F.md5(F.concat(F.lit(f"{seed}-"), F.col("pos").cast("string"))))
    return r.where(F.col("rank") < first).drop("rank"), r.where(F.col("rank") >= first).drop("rank")


def renumbered(rows: DataFrame, by: Column) -> DataFrame:
    """`pos` from 0 in the order of a number that isn't negative, ranges of it being numbered each for itself."""
    top = rows.agg(F.max(by)).first()[0] or 0
    width = max(1, -(-(int(top) + 1) // 4096))  # at most 4096 ranges of the old numbers
    b = rows.withColumn("_v", by.cast("bigint")).withColumn("_b", F.floor(F.col("_v") / width))
    sizes = b.groupBy(F.col("_b").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_of", before.alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_v")) - 1
    return b.join(starts, F.col("_b") == F.col("_of")).withColumn("pos", (F.col("_start") + inside).cast("bigint")).drop("_v", "_b", "_of", "_start")


def chunks(corpus: DataFrame, size: int) -> DataFrame:
    """Adds `chunk`, the number of the run of `size` positions that a row is in."""
    return corpus.withColumn("chunk", F.floor(F.col("pos") / size).cast("bigint"))


def or_empty(tokens: Column, mark: str = "<EMPTY>") -> Column:
    """Tokens, or the mark alone where there are none."""
    return F.when(F.size(F.coalesce(tokens, F.array().cast("array<string>"))) == 0, F.array(F.lit(mark))).otherwise(tokens)
