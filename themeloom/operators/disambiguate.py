"""Which entity a mention means: the candidates' vectors against the document's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from . import vectors as V


def candidates(found: DataFrame, docs_lang: DataFrame, lexicon: DataFrame, fallback: str = "en") -> DataFrame:
    """``(doc_id, start, num, ord)``: the entities that each mention's key stands for, in lexicon order.

    `docs_lang(doc_id, lang)` tells the language a text was matched in.
    """
    keyed = found.join(docs_lang, "doc_id").select("doc_id", "start", "key", "lang")
    return keyed.join(lexicon.select("lang", "key", "ids"), ["lang", "key"]).select("doc_id", "start", F.posexplode("ids").alias("ord", "num"))


def mean_of_candidates(found: DataFrame, entity_vectors: DataFrame, dims: int) -> DataFrame:
    """``(doc_id, vec)``: the default encoder, a document's vector is the mean of the vectors of all candidates of all its mentions."""
    return V.weighted_mean(found.join(entity_vectors, "num").select("doc_id", "vec"), "doc_id", "vec", dims)


def scored(pairs: DataFrame, doc_vectors: DataFrame, entity_vectors: DataFrame, threshold: float, floor: DataFrame | None = None) -> DataFrame:
    """``(doc_id, num, score)``: cosine of document and entity for the distinct `pairs(doc_id, num)`, from `threshold` times the document's best on.

    Entities without a vector, and scores of zero, are left out. Pairs are made distinct before the vectors are joined to them.
    """
    each = pairs.select("doc_id", "num").distinct().join(entity_vectors, "num").join(doc_vectors.select("doc_id", F.col("vec").alias("doc_vec")), "doc_id")
    with_score = each.select("doc_id", "num", S.cosine(F.col("vec"), F.col("doc_vec")).alias("score")).where("score is not null")
    best = with_score.groupBy("doc_id").agg(F.max("score").alias("best"))
    return with_score.join(best, "doc_id").where((F.col("score") >= F.lit(threshold) * F.col("best")) & (F.col("score") != 0)).select("doc_id", "num", "score")


def chosen(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """``(doc_id, start, num)``: each mention's candidate with the highest score, rounded to nine decimals; ties by lexicon order. Mentions without one are left out."""
    joined = cands.join(scores, ["doc_id", "num"])
    return joined.groupBy("doc_id", "start").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "ord", "num")).alias("best")).select("doc_id", "start", F.col("best.num").alias("num"))


def extended(picked: DataFrame, properties: DataFrame, doc_vectors: DataFrame, entity_vectors: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, num)``: the chosen entities, a row per mention, and for each of them its distinct property values that score well enough among all the values."""
    values = properties.select("num", "value").distinct()
    more = picked.join(values, "num").select("doc_id", F.col("value").alias("num"))
    good = scored(more, doc_vectors, entity_vectors, threshold)
    return picked.select("doc_id", "num").unionAll(more.join(good.select("doc_id", "num"), ["doc_id", "num"], "left_semi").select("doc_id", "num"))


def bags(picked: DataFrame, at_least: int = 1) -> DataFrame:
    """``(doc_id, num, n)``: how often each entity is meant in each document; documents with fewer than `at_least` mentions are left out."""
    counts = picked.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"))
    if at_least <= 1:
        return counts
    enough = counts.groupBy("doc_id").agg(F.sum("n").alias("t")).where(F.col("t") >= at_least).select("doc_id")
    return counts.join(enough, "doc_id", "left_semi")
