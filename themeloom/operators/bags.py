"""Bags: sparse numeric vectors as rows ``(owner, key, value)``, with their algebra.

Operands are long tables, so a bag of any size is only rows. A missing key counts as 0 in operations over the union of keys; with `intersection` only common keys remain. Rows with a null owner
or key are left out; repeated rows of one key are added up first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-operand operations; a division by zero gives null, modulo has the divisor's sign.
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "floordiv": lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    "mod": lambda a, b: a - b * F.floor(F.try_divide(a, b)),
    "pow": lambda a, b: F.pow(a, b),
}
COMPARISONS: dict[str, Callable[[Column, float], Column]] = {"gt": lambda a, c: a > c, "ge": lambda a, c: a >= c, "lt": lambda a, c: a < c, "le": lambda a, c: a <= c, "eq": lambda a, c: a == c, "ne": lambda a, c: a != c}


def bag(rows: DataFrame, owner: str, key: str, value: str | None = None) -> DataFrame:
    """``(owner, key, value)``: the sum of the values of each key, or its number of rows."""
    v = F.lit(1.0) if value is None else F.col(value).cast("double")
    return rows.select(F.col(owner).alias("owner"), F.col(key).alias("key"), v.alias("value")).where("owner is not null and key is not null").groupBy("owner", "key").agg(F.sum("value").alias("value"))


def combine(left: DataFrame, right: DataFrame, operation: str, intersection: bool = False, strict: bool = False) -> DataFrame:
    """`operation` on two tables of bags, key by key within each owner. `strict` raises where a divisor is missing or zero."""
    if operation == "add" and not intersection:
        return left.unionByName(right).groupBy("owner", "key").agg(F.sum("value").alias("value"))
    r = right.select(F.col("owner").alias("o"), F.col("key").alias("k"), F.col("value").alias("v"))
    both = left.join(r, (F.col("owner") == F.col("o")) & (F.col("key") == F.col("k")), "inner" if intersection else "full")
    a, b = F.coalesce("value", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    result = OPERATIONS[operation](a, b)
    if strict and operation in ("div", "floordiv", "mod"):
        result = F.when(b == 0, F.raise_error(F.lit("missing key or zero in the divisor")).cast("double")).otherwise(result)
    return both.select(F.coalesce("owner", "o").alias("owner"), F.coalesce("key", "k").alias("key"), result.alias("value"))


def scalar(bags: DataFrame, operation: str, c: float, reflected: bool = False) -> DataFrame:
    """`operation` with a number on every existing key; reflected, the number is the left operand."""
    a, b = F.col("value"), F.lit(float(c))
    return bags.withColumn("value", OPERATIONS[operation](b, a) if reflected else OPERATIONS[operation](a, b))


def negate(bags: DataFrame) -> DataFrame:
    return bags.withColumn("value", -F.col("value"))


def inner(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(owner, value)``: the sum of products over common keys."""
    return combine(left, right, "mul", intersection=True).groupBy("owner").agg(F.sum("value").alias("value"))


def compare(bags: DataFrame, comparison: str, c: float) -> DataFrame:
    """The part of each bag whose values compare so with the number."""
    return bags.where(COMPARISONS[comparison](F.col("value"), c))


def holds_any(bags: DataFrame, comparison: str, c: float) -> DataFrame:
    """``(owner, holds)``: whether any value of the bag compares so with the number."""
    return bags.groupBy("owner").agg(F.bool_or(COMPARISONS[comparison](F.col("value"), c)).alias("holds"))


def frequencies(bags: DataFrame) -> DataFrame:
    """Values divided by their bag's sum; bags with sum 0 stay as they are."""
    total = bags.groupBy(F.col("owner").alias("o")).agg(F.sum("value").alias("total"))
    return bags.join(total, F.col("owner") == F.col("o")).select("owner", "key", F.when(F.col("total") == 0, F.col("value")).otherwise(F.col("value") / F.col("total")).alias("value"))


def head(bags: DataFrame, n: int) -> DataFrame:
    """The `n` largest values of each bag with their rank; ties by key. Ranking is limited before the shuffle."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("value"), "key"))
    return bags.withColumn("place", place).where(F.col("place") <= n)


def tail(bags: DataFrame, n: int) -> DataFrame:
    """The last `n` of each bag's descending order, the last first; ties by key."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("value", F.desc("key")))
    return bags.withColumn("place", place).where(F.col("place") <= n)


def filtered(bags: DataFrame, keys: Callable[[Column], Column] | None = None, values: Callable[[Column], Column] | None = None) -> DataFrame:
    """The part of each bag whose keys and values satisfy the predicates."""
    return bags.where((keys(F.col("key")) if keys else F.lit(True)) & (values(F.col("value")) if values else F.lit(True)))


def in_vocabulary(tokens: DataFrame, token: str, vocabulary: DataFrame) -> DataFrame:
    """The rows whose token is in the only column of `vocabulary`, as often as they stand there."""
    v = vocabulary.select(F.col(vocabulary.columns[0]).alias("_v")).distinct()
    return tokens.join(v, F.col(token) == F.col("_v"), "left_semi")


def density(bags: DataFrame) -> DataFrame:
    """``(density)``: the share of positive cells of the matrix of owners and keys."""
    cells = bags.agg(F.count_distinct("owner").alias("o"), F.count_distinct("key").alias("k"), F.count_if(F.col("value") > 0).alias("p"))
    return cells.select(F.try_divide(F.col("p").cast("double"), F.col("o") * F.col("k")).alias("density"))


def normalised_rows(weights: DataFrame, n: int) -> DataFrame:
    """``(owner, key, value, place)``: each row of a weight matrix divided by its sum, its n largest entries."""
    return head(frequencies(weights), n)
