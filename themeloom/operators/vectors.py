"""Entity and document vectors: unit vectors, weighted means, two-part vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..session import ship


def usable(rows: DataFrame, num: str, vector: str, dims: int) -> DataFrame:
    """``(num, vec)``: double vectors of length 1; null, wrongly sized, not finite and zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            x = sized.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)  # null becomes NaN
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
            fit = np.isfinite(x).all(axis=1) & (norm > 0)
            x = x[fit] / norm[fit][:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([sized.column(0).filter(pa.array(fit)), lists], names=["num", "vec"])

    ship(rows.sparkSession)
    return rows.select(F.col(num).cast("bigint").alias("num"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "num bigint, vec array<double>")


def weighted_mean(rows: DataFrame, by: str, vector: str, dims: int, weight: str | None = None) -> DataFrame:
    """``(by, vec)``: the mean of the vectors of each group, weighted by a column. One sum per dimension, combined before the shuffle."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = rows.withColumn("_w", w).groupBy(by).agg(F.sum("_w").alias("_total"), *[F.sum(F.col(vector)[i].cast("double") * F.col("_w")).alias(f"_{i}") for i in range(dims)])
    return sums.select(by, F.array(*[F.try_divide(F.col(f"_{i}"), F.col("_total")) for i in range(dims)]).alias("vec"))


def bimodal(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """``(num, vec)``: both vectors of an entity, the first scaled by the root of 1 / (1 + alpha), the second by the root of the rest; entities lacking one are left out."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    w = 1 / (1 + alpha)
    b = second.select("num", F.col("vec").alias("vec2"))
    return first.join(b, "num").select("num", F.concat(F.transform("vec", lambda x: x * math.sqrt(w)), F.transform("vec2", lambda x: x * math.sqrt(1 - w))).alias("vec"))


def missing(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(num)`` of the entities without a vector."""
    return entities.select("num").join(vectors.select("num"), "num", "left_anti")


def gram(rows: DataFrame, num: str, vector: str, max_rows: int = 4096) -> DataFrame:
    """``(a, b, cosine)`` of all rows with all: a matrix, for sets that are small by nature (classes, centroids). More than `max_rows` rows are refused; similar pairs of large sets
    are what blocked neighbour joins are for."""
    n = rows.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"a Gram matrix of more than {max_rows} rows is refused")
    one = rows.select(F.col(num).alias("a"), F.col(vector).alias("va"), F.lit(1).alias("one"))
    two = F.broadcast(one.select(F.col("a").alias("b"), F.col("va").alias("vb"), "one"))
    return one.join(two, "one").select("a", "b", S.cosine(F.col("va"), F.col("vb")).alias("cosine"))
