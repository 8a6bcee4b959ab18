"""Streams of documents: mentions, entity bags and topics as they arrive.

Each document is worked on by itself against static tables (lexicon, vectors, centroids), so these are stateless maps. Counts over event time keep state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching


def mention_stream(docs: DataFrame, doc_id: str, text: str, lang: str, lexicon: DataFrame) -> DataFrame:
    """Mentions in a stream of documents; the lexicon must fit in one block, as overlaps in a larger one need the whole document's matches at once."""
    return matching.mentions(docs, doc_id, text, lang, lexicon)


def windowed_counts(mentions: DataFrame, at: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(window, key, n)`` over event time; rows later than `late` are left out, and so is the state of windows older than that."""
    return mentions.withWatermark(at, late).groupBy(F.window(at, width), "key").agg(F.count(F.lit(1)).alias("n"))


def each_batch(docs: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over every micro-batch and writes its rows as a table, once per batch also after a restart: a batch's folder is overwritten when it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
