"""Random walks over the edge file, and vectors of entities from them.

A step is a join: a walk draws a number below its node's number of neighbours, by a hash of the walk and the step, and meets the neighbour with this number. All walks take a step together, and a walk that
comes to a node without neighbours ends there. Neighbours are numbered in salted parts, so a node with a large part of all edges is never sorted in one task, and the draws spread walks at such a node over its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def neighbours(edges: DataFrame, src: str, dst: str, salts: int = 64) -> DataFrame:
    """``(node, i, next, n)``: the distinct neighbours of each node, numbered from 0 to n - 1. Edges with a null end and edges to the node itself are left out."""
    e = edges.select(F.col(src).cast("bigint").alias("node"), F.col(dst).cast("bigint").alias("next")).where("node is not null and next is not null and node <> next").distinct()
    e = e.withColumn("salt", F.pmod(F.xxhash64("next"), F.lit(salts)))
    parts = e.groupBy("node", "salt").agg(F.count(F.lit(1)).alias("size"))
    of = Window.partitionBy("node")  # at most `salts` rows a node
    parts = parts.select("node", "salt", F.coalesce(F.sum("size").over(of.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(of).alias("n"))
    placed = e.withColumn("place", F.row_number().over(Window.partitionBy("node", "salt").orderBy("next")) - 1)
    return placed.join(parts, ["node", "salt"]).select("node", (F.col("before") + F.col("place")).alias("i"), "next", "n")


def random_walks(edges: DataFrame, src: str, dst: str, length: int = 10, per_node: int = 1, seed: int = 1) -> DataFrame:
    """``(start, walk, path)``: `per_node` walks from each node of the edges, of at most `length` nodes; the same edges and seed give the same walks. A node without neighbours is a walk by itself."""
    near = materialise(neighbours(edges, src, dst))
    ends = edges.select(F.col(src).cast("bigint").alias("start")).union(edges.select(F.col(dst).cast("bigint"))).where("start is not null").distinct()
    degrees = near.where("i = 0").select(F.col("node").alias("at"), "n")
    state = ends.select("start", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk")).select("start", "walk", F.col("start").alias("at"), F.array("start").alias("path"))
    for step in range(1, length):
        drawn = state.join(degrees, "at", "left").withColumn("i", F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.col("n")))
        moved = drawn.join(near.select(F.col("node").alias("at"), "i", "next"), ["at", "i"], "left")
        # a walk that has ended keeps its node, and has no neighbour to draw in any later step either
        state = materialise(moved.select("start", "walk", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path")))
    return state.select("start", "walk", "path")


def walk_vectors(walks: DataFrame, dims: int, window: int = 5, iterations: int = 1, seed: int = 1, most_bytes: int = 1 << 30) -> DataFrame:
    """``(num, vec)``: vectors of all nodes of the walks, by the library's skip-gram model. It holds the table of vectors in one piece, which is refused beyond `most_bytes`."""
    from pyspark.ml.feature import Word2Vec

    sentences = materialise(walks.select(F.transform("path", lambda x: x.cast("string")).alias("path")))
    nodes = sentences.agg(F.count_distinct(F.col("path")[0])).first()[0]  # every node begins a walk
    if nodes * dims * 4 > most_bytes:
        raise ValueError(f"{nodes} nodes of {dims} dimensions exceed {most_bytes} bytes")
    if not nodes:
        return walks.sparkSession.createDataFrame([], "num bigint, vec array<double>")
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dims, minCount=1, windowSize=window, maxIter=iterations, seed=seed, inputCol="path", outputCol="v").fit(sentences)
    return model.getVectors().select(F.col("word").cast("bigint").alias("num"), vector_to_array("vector").alias("vec"))
