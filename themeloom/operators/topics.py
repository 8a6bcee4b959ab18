"""Topics as clusters of entity vectors: training, topic words, inference, refreshing words from a corpus.

Centroids are the only thing the driver holds: k vectors, k a parameter. Assigning rows to centroids is a matrix product per Arrow batch; of the rows, only per-task sums by
centroid leave a task, of a document's topics only as many as are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """By a matrix product; small distances, and rows whose two nearest centroids are all but equally far, by differences, which don't cancel."""
    d2 = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T)
    scale = 1e-6 * max(1.0, float(np.abs(d2).max(initial=0)))
    i, j = np.nonzero(d2 < scale)
    d2[i, j] = ((x[i] - centroids[j]) ** 2).sum(axis=1)
    if d2.shape[1] > 1:
        two = np.partition(d2, 1, axis=1)[:, :2]
        for i in np.flatnonzero(two[:, 1] - two[:, 0] < scale * 1e-3).tolist():
            d2[i] = ((x[i] - centroids) ** 2).sum(axis=1)
    return d2


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                label = squared_distances(x, c).argmin(axis=1)
                np.add.at(total, label, x)
                n += np.bincount(label, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["topic", "n", "total"])

    return vectors.select("vec").mapInArrow(run, "topic int, n bigint, total array<double>")


def lloyd(vectors: DataFrame, start: np.ndarray, iterations: int) -> np.ndarray:
    """Centroids after the given number of Lloyd iterations from `start`, or when none moves any more; a centroid without rows stays. `vectors` should be materialised."""
    centroids = np.array(start, float)
    if not len(centroids):
        return centroids

    def together(parts: pa.Table) -> pa.Table:
        n = parts.column("n").to_numpy().sum()
        return pa.table({"topic": parts.column("topic")[:1], "n": pa.array([n]), "total": pa.array([_matrix(parts.column("total").combine_chunks()).sum(axis=0).tolist()])})

    for _ in range(iterations):
        sums = _sums(vectors, centroids).groupBy("topic").applyInArrow(together, "topic int, n bigint, total array<double>")  # a row per task and topic
        before = centroids.copy()
        for r in sums.collect():  # k rows
            if r.n:
                centroids[r.topic] = np.array(r.total) / r.n
        if np.allclose(centroids, before, rtol=0, atol=1e-12):  # sums differ by their order
            break
    return centroids


def start_vectors(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k lowest entities, a fixed start; fewer where there are fewer, an empty matrix where there are none."""
    rows = [r.vec for r in vectors.orderBy("num").limit(k).collect()]
    return np.array(rows, float) if rows else np.empty((0, 0))


def _per_batch(vectors: DataFrame, num: str, centroids: np.ndarray, schema: str, work: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """`work(numbers, squared distances to all centroids)` over slices of Arrow batches; a row's distances are together, so nothing about a single row needs a shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                columns = work(part.column(0).to_numpy(), squared_distances(_matrix(part.column(1)), shared.value))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return vectors.select(F.col(num).cast("bigint").alias("num"), "vec").mapInArrow(run, schema)


def nearest(vectors: DataFrame, num: str, centroids: np.ndarray) -> DataFrame:
    """``(num, topic, d2)``: each row's nearest centroid, ties by the lower topic."""
    return _per_batch(vectors, num, centroids, "num bigint, topic int, d2 double", lambda n, d2: [n, d2.argmin(axis=1).astype(np.int32), d2.min(axis=1)])


def topic_words(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """``(topic, place, num, score)``: the `n` entities nearest to each centroid; scores are proportional to 1 / (d2 + 1e-6) and add up to 1. Fewer entities give fewer words.

    Every batch sends on its own `n` nearest only.
    """

    def work(numbers: np.ndarray, d2: np.ndarray) -> list[np.ndarray]:
        best = np.stack([np.lexsort((numbers, column))[:n] for column in d2.T])
        topic = np.repeat(np.arange(len(best), dtype=np.int32), best.shape[1])
        return [numbers[best.ravel()], topic, d2[best.ravel(), topic]]

    d = _per_batch(vectors, "num", centroids, "num bigint, topic int, d2 double", work)
    top = d.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("d2", "num"))).where(F.col("place") <= n)
    w = 1 / (F.col("d2") + EPS)
    return top.select("topic", "place", "num", (w / F.sum(w).over(Window.partitionBy("topic"))).alias("score"))


def document_topics(doc_vectors: DataFrame, centroids: np.ndarray, exponent: int = 2, n: int | None = None) -> DataFrame:
    """``(doc_id, topic, d2, prob, place)``: probabilities proportional to 1 / d2 ** exponent over all topics, nearest topics first; with `n` only the n nearest leave the batch.

    A document at a topic's very place has probability 1, shared among such topics.
    """

    def work(numbers: np.ndarray, d2: np.ndarray) -> list[np.ndarray]:
        exact = d2 == 0
        with np.errstate(divide="ignore"):
            w = np.where(exact.any(axis=1, keepdims=True), exact.astype(float), 1 / d2**exponent)
        prob = w / w.sum(axis=1, keepdims=True)
        topic = d2.argsort(axis=1, kind="stable")[:, :n]
        k = topic.shape[1]
        take = lambda m: np.take_along_axis(m, topic, axis=1).ravel()
        return [np.repeat(numbers, k), topic.ravel().astype(np.int32), take(d2), take(prob), np.tile(np.arange(1, k + 1, dtype=np.int32), len(numbers))]

    return _per_batch(doc_vectors, "doc_id", centroids, "doc_id bigint, topic int, d2 double, prob double, place int", work)


def top_topics(doc_topics: DataFrame, n: int) -> DataFrame:
    return doc_topics.where(F.col("place") <= n)


def best_topic(docs: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """``(doc_id, topic)``: every document's nearest topic, -1 for one without a vector."""
    first = doc_topics.where("place = 1").select("doc_id", "topic")
    return docs.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.coalesce("topic", F.lit(-1)).alias("topic"))


def refreshed_words(freqs: DataFrame, doc_topics: DataFrame, old: DataFrame, n_topics_per_doc: int, n: int = 1000, prior: float = 1e-12) -> DataFrame:
    """``(topic, place, num, score)``: topic words from a corpus: the sum over documents of word frequency times probability of the topic, plus a trace of the old
    score; the best `n` per topic, adding up to 1. `freqs(doc_id, num, freq)`, `old(topic, num, score)`."""
    grown = freqs.join(top_topics(doc_topics, n_topics_per_doc).select("doc_id", "topic", "prob"), "doc_id").select("topic", "num", (F.col("freq") * F.col("prob")).alias("v"))
    both = grown.unionAll(old.select("topic", "num", (F.col("score") * prior).alias("v"))).groupBy("topic", "num").agg(F.sum("v").alias("v"))
    top = both.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("v", 12)), "num"))).where(F.col("place") <= n)
    return top.select("topic", "place", "num", (F.col("v") / F.sum("v").over(Window.partitionBy("topic"))).alias("score"))


def usable_topics(words: DataFrame, min_score: float = 1e-4, min_words: int = 1) -> DataFrame:
    """Topic words above `min_score`, of topics that have at least `min_words` of them."""
    kept = words.where(F.col("score") > min_score)
    return kept.join(kept.groupBy("topic").count().where(F.col("count") >= min_words).select("topic"), "topic", "left_semi")
