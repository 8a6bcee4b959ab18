"""How characteristic each term is of its record: probabilistic relevance weights (BM25) against the whole collection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

IDFS = ("plain", "probabilistic")


def term_weights(records: DataFrame, rec: str, terms: str, k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic", min_records: int = 1) -> DataFrame:
    """``(rec, term, n, m, weight)`` for each term of the array column `terms` of each record.

    n is how often the record lists the term and m in how many records it stands. weight = idf * n * (k1 + 1) / (n + k1 * (1 - b + b * length
    / mean length)); with k1 = inf the frequency doesn't saturate and the weight is idf * n. idf is ln(N / m) (``plain``) or
    ln(1 + (N - m + 0.5) / (m + 0.5)) (``probabilistic``), N the number of records with at least one term. Terms in fewer than `min_records` records
    are left out of the result, not of the counts. Null terms, null or empty arrays and null records count for nothing; `rec` must be unique.

    Counts are combined before each shuffle. The weights join the counts by term; the hot side of that join is a plain fact table of narrow rows, which
    adaptive execution splits when one term is listed by a large part of all records.
    """
    if idf not in IDFS or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("idf must be one of plain and probabilistic, k1 at least 0, b between 0 and 1")
    given = records.select(F.col(rec).alias("rec"), F.filter(F.col(terms), lambda x: x.isNotNull()).alias("terms")).where("rec is not null and size(terms) > 0")
    listed = materialise(given.select("rec", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("rec", "length", "term").agg(F.count(F.lit(1)).alias("n")))
    total, mean = listed.groupBy("rec").agg(F.first("length").alias("length")).agg(F.count(F.lit(1)), F.avg("length")).first()
    m, n, records_n = F.col("m"), F.col("n"), F.lit(float(total))
    known = F.ln(records_n / m) if idf == "plain" else F.ln(1 + (records_n - m + 0.5) / (m + 0.5))
    saturated = n.cast("double") if math.isinf(k1) else n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
    counts = listed.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("m")).where(m >= min_records)
    return listed.join(counts, F.col("term") == F.col("t")).select("rec", "term", "n", "m", (saturated * known).alias("weight"))


def most_characteristic(weights: DataFrame, digits: int = 6) -> DataFrame:
    """``(rec, term, weight)``: each record's term with the highest weight, rounded to `digits` decimals; the smallest term wins a tie."""
    best = weights.groupBy("rec").agg(F.min(F.struct((-F.round("weight", digits)).alias("w"), F.col("term").alias("t"))).alias("best"))
    return best.select("rec", F.col("best.t").alias("term"), (-F.col("best.w")).alias("weight"))
