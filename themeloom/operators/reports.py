"""Topics and documents as tables to read: wide, JSON and Markdown forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(topics: DataFrame, n: int, min_score: float = 0.0) -> DataFrame:
    """A row per topic with ``id_i, word_i, score_i`` for its first n words above `min_score`. `topics(topic, place, num, label, score)`; one aggregation, no extra pass for the columns."""
    kept = topics.where(F.col("score") > min_score)
    at = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c)))
    return kept.groupBy("topic").agg(*[at(c, i).alias(f"{name}_{i}") for i in range(1, n + 1) for c, name in (("num", "id"), ("label", "word"), ("score", "score"))])


def matrix(topics: DataFrame, words: list[int]) -> DataFrame:
    """A row per topic with a column per word, its own score or 0."""
    return topics.groupBy("topic").agg(*[F.coalesce(F.sum(F.when(F.col("num") == w, F.col("score"))), F.lit(0.0)).alias(f"w{w}") for w in words])


def weights(topics: DataFrame) -> DataFrame:
    """The whole matrix in long form, ``(topic, num, weight)``: every topic with every word of any topic, 0 where it isn't its own. The topics, a bounded number, are all that is collected."""
    numbers = sorted(r.topic for r in topics.select("topic").distinct().collect())
    cells = topics.select("num").distinct().select(F.explode(F.array(*[F.lit(t) for t in numbers]).cast("array<int>")).alias("topic"), "num")
    return cells.join(topics.groupBy("topic", "num").agg(F.sum("score").alias("weight")), ["topic", "num"], "left").select("topic", "num", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _ordered(value: Column, n: int) -> Column:
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), 1, n), lambda x: x["v"])


def as_json(topics: DataFrame, n: int = 25) -> DataFrame:
    """``(topic, json)``: an object with the topic's number as six digits and its words."""
    grouped = topics.groupBy("topic").agg(_ordered(F.col("label"), n).alias("FeatureWords"))
    return grouped.select("topic", F.to_json(F.struct("FeatureWords", F.lpad(F.col("topic").cast("string"), 6, "0").alias("TopicID"))).alias("json"))


def as_markdown(topics: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, line)``: a table row with the topic's number and its words with their scores."""
    cell = F.concat("label", F.lit(" ("), F.format_string("%.3f", F.col("score")), F.lit(")"))
    grouped = topics.groupBy("topic").agg(_ordered(cell, n).alias("cells"))
    return grouped.select("topic", F.concat(F.lit("| "), F.col("topic").cast("string"), F.lit(" | "), F.array_join("cells", ", "), F.lit(" |")).alias("line"))


def upper_words(topics: DataFrame, n: int = 25) -> DataFrame:
    """The first n words of each topic in upper case, scores to six decimals."""
    return topics.where(F.col("place") <= n).select("topic", "place", F.upper("label").alias("word"), F.round("score", 6).alias("score"))


def document_report(doc_topics: DataFrame, n: int) -> DataFrame:
    """``(doc_id, topic_1 .. topic_n)``: each document's first topics as ``number (probability)``."""
    cell = F.concat(F.col("topic").cast("string"), F.lit(" ("), F.format_string("%.3f", F.col("prob")), F.lit(")"))
    return doc_topics.groupBy("doc_id").agg(*[F.max(F.when(F.col("place") == i, cell)).alias(f"topic_{i}") for i in range(1, n + 1)])
