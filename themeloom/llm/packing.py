"""Filling fixed-capacity containers: sum-of-squares packing, sharded.

The sum-of-squares rule (Csirik, Johnson, Kenyon, Orlin, Shor and Weber) keeps N(g), the number of open containers with gap g, and puts each item
where the sum of N(g)**2 over gaps 0 < g < capacity becomes smallest. Items are routed to shards of a bounded number of items and packed there; the
containers that a shard leaves badly filled are then packed again as wholes, across shards, with the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item, in the order given; sizes must be from 1 to `capacity`.

    Putting an item of size s into a container with gap g changes the sum by 2 * (N(g - s) - N(g)) + 2, opening one by 2 * N(capacity - s) + 1; gaps 0 and
    `capacity` don't count. Among equals the smallest gap wins, and an open container wins over a new one.
    """
    n = np.zeros(capacity + 1, np.int64)  # N(g); n[0] stays 0
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    for k, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(n[s:]) + s
        best, g = 2 * n[capacity - s] + 1 if s < capacity else 0, capacity
        if len(gaps):
            left = gaps - s
            change = 2 * (np.where(left > 0, n[left], 0) - n[gaps]) + np.where(left > 0, 2, 1)
            i = int(np.argmin(change))
            if change[i] <= best:
                g = int(gaps[i])
        if g == capacity:
            container, made = made, made + 1
        else:
            container = open_[g].pop()
            n[g] -= 1
        out[k] = container
        if g - s > 0:
            open_[g - s].append(container)
            n[g - s] += 1
    return out


def _pass(items: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """``(item, size)`` -> ``(item, size, container)``; containers are numbered shard by shard, largest items first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        for shard, part in pd.concat(frames).groupby("shard", sort=True):
            part = part.sort_values(["size", "item"], ascending=[False, True])
            part["container"] = sum_of_squares(part["size"].to_numpy(), capacity) * shards + shard
            yield part[["item", "size", "container"]]

    routed = items.select("item", F.col("size").cast("int").alias("size"), F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"))
    return routed.repartition(shards, "shard").mapInPandas(run, "item bigint, size int, container bigint")


def character_cuts(data: bytes, capacity: int) -> list[int]:
    """Where a text is cut into pieces of at most `capacity` bytes, as long as possible, between characters; its end is no cut."""
    cuts, at = [], 0
    while at + capacity < len(data):
        at += capacity
        while data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    return cuts


def text_sizes(docs: DataFrame, doc: str, text: str, capacity: int) -> DataFrame:
    """``(doc, size, cuts)``: the bytes of each text, and where one above `capacity` is to be cut; only such texts go through Python."""
    if capacity < 4:
        raise ValueError("a container must hold a character")

    @F.pandas_udf("array<bigint>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else character_cuts(t.encode(), capacity))

    size = F.octet_length(text)
    return docs.select(F.col(doc).alias("doc"), size.alias("size"), cuts(F.when(size > capacity, F.col(text))).alias("cuts"))


def pack(items: DataFrame, item: str, size: str, capacity: int, shard_items: int = 50_000, full: float = 0.97, cuts: str | None = None) -> DataFrame:
    """``(item, piece, start, n, container, used)``: the container of every piece of every row; `item` is a bigint that names the row, `size` a count.

    A row above `capacity` is cut at every multiple of it, or at the places in the array column `cuts`, no two farther apart than that; no other row is divided. Pieces that end at a cut have a container
    of their own and meet no shuffle but the result's. Rows of size 0 or less, or null, take no room: they have one piece with container null. `used` is the container's fill.
    Containers filled less than `full` are packed again with those of the other shards; a shard never has more than about `shard_items`. Rows are told apart by themselves, so
    repeated and null items are packed like any other.
    """
    size_ = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    multiples = F.when(F.col("size") >= capacity, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.floor(F.col("size") / capacity), F.lit(1))), lambda i: i * capacity))
    given = F.lit(None).cast("array<bigint>") if cuts is None else F.col(cuts)
    base = items.select(F.col(item).cast("bigint").alias("item"), size_.alias("size"), given.alias("given"))
    at = F.coalesce("given", multiples, F.array().cast("array<bigint>"))
    last = F.coalesce(F.try_element_at("cuts", F.lit(-1)), F.lit(0))
    rest = materialise(base.select(F.monotonically_increasing_id().alias("row"), "item", "size", at.alias("cuts")).withColumn("rest", F.col("size") - last))
    small = rest.where("rest > 0").select(F.col("row").alias("item"), F.col("rest").alias("size"))
    n = small.count()
    cores = items.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_items), min(cores, n // 10_000))
    first = materialise(_pass(small, capacity, shards, 1))
    fill = materialise(first.groupBy("container").agg(F.sum("size").alias("fill")))
    loose = fill.where(F.col("fill") < F.lit(full * capacity)).select(F.col("container").alias("item"), F.col("fill").alias("size"))
    again = _pass(loose, capacity, max(1, -(-loose.count() // shard_items)), 2).select(F.col("item").alias("container"), F.col("container").alias("joined"))
    # first-pass containers are a, second-pass ones b, those of pieces that end at a cut f with the row's number: no two kinds share a name
    moved = first.join(again, "container", "left").select("item", "size", F.when(F.col("joined").isNotNull(), F.concat(F.lit("b"), "joined")).otherwise(F.concat(F.lit("a"), "container")).alias("container"))
    used = moved.groupBy("container").agg(F.sum("size").alias("used"))
    packed = moved.join(used, "container").select(F.col("item").alias("r"), "container", "used")
    tails = rest.where("rest > 0").join(packed, F.col("row") == F.col("r")).select("item", F.size("cuts").cast("bigint").alias("piece"), last.alias("start"), F.col("rest").alias("n"), "container", F.col("used").cast("bigint").alias("used"))
    pieces = rest.select("row", "item", "cuts", F.posexplode("cuts").alias("piece", "stop"))
    start = F.when(F.col("piece") == 0, F.lit(0).cast("bigint")).otherwise(F.try_element_at("cuts", F.col("piece")))
    full_ = pieces.select("row", "item", F.col("piece").cast("bigint").alias("piece"), start.alias("start"), (F.col("stop") - start).alias("n"))
    full_ = full_.select("item", "piece", "start", "n", F.concat(F.lit("f"), "row", F.lit("."), "piece").alias("container"), F.col("n").alias("used"))
    nothing = F.lit(0).cast("bigint")
    empty = rest.where("size = 0").select("item", nothing.alias("piece"), nothing.alias("start"), nothing.alias("n"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("used"))
    return full_.unionByName(tails).unionByName(empty)
