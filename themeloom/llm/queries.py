"""Queries of the training-data operators over the test tables, and their oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_number, entity_numbers
from ..operators.states import latest_state
from ..session import materialise, ship
from . import content, density, leaks, packing, pairs, pieces, terms, weights
from .oracles import ORACLES

CAPACITY, LIMIT, OVERLAP = 4096, 2048, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, page_no, items)`` of the current pages with at least one id in text_entities; key is the page's own number."""
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "items": entity_numbers("text_entities")})
    return now.where("size(items) > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic other entity of each current page: unsaturated frequency times ln(N / m), ids of one page only left out."""
    pages = materialise(listed_entities(spark, sf_dir))
    scored = weights.term_weights(pages, "page_no", "items", k1=math.inf, b=0.0, idf="plain", min_records=2)
    own = pages.select(F.col("page_no").alias("p"), F.col("key").alias("own"))
    others = scored.join(own, F.col("rec") == F.col("p")).where("term <> own")
    return weights.most_characteristic(others).select(F.col("rec").alias("page_no"), F.col("term").alias("entity_no"))


def p2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating, length-normalised weight of every entity of every current page."""
    scored = weights.term_weights(listed_entities(spark, sf_dir), "page_no", "items")
    return scored.select(F.col("rec").alias("page_no"), F.col("term").alias("entity_no"), "n", "m", F.round("weight", 6).alias("weight"))


def _page_clusters(spark: SparkSession, sf_dir: str, densities: bool) -> DataFrame:
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "embedding": F.col("embedding")})
    return density.density_peaks(now, "page_no", "embedding", 64, densities=densities)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each group of two or more similar current pages."""
    return _page_clusters(spark, sf_dir, False).where("size >= 2").select(F.col("cluster").alias("cluster_first"), F.col("rec").alias("page_no"))


def p3_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and three most typical pages of each group."""
    top = density.typical(_page_clusters(spark, sf_dir, True).where("size >= 2"))
    return top.select(F.col("cluster").alias("cluster_first"), F.col("size").alias("cluster_size"), F.col("member").alias("page_no"), "place")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page's text that isn't part of the article."""
    return content.other_lines(table(spark, sf_dir, "wiki_page"), "page_no", "site", "enwiki", "text", "page")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are too rare (fewer than 4 occurrences) or too common (on more than a fifth of the pages)."""
    pages = materialise(listed_entities(spark, sf_dir))
    counts = terms.mark(terms.ngram_counts(pages, "items"), pages.count(), 4, 0.2)
    return counts.where("mark is not null").select(F.col("ngram")[0].alias("entity_no"), "mark")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and pages of every run of up to three entities; the run as text."""
    counts = terms.ngram_counts(listed_entities(spark, sf_dir), "items", 3)
    return counts.select(F.concat_ws(" ", F.transform("ngram", lambda x: x.cast("string"))).alias("ngram"), "length", "occurrences", "records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities that share at least 5 pages, at least 6 times as many as by chance."""
    return pairs.pair_counts(listed_entities(spark, sf_dir), "items", 5, 6.0).select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def p6_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared pages, lift and normalised pointwise mutual information of those pairs."""
    found = pairs.pair_counts(listed_entities(spark, sf_dir), "items", 5, 6.0)
    npmi = F.ln("lift") / -F.ln(F.col("shared") / F.col("n_records"))
    return found.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "shared", F.round("lift", 6).alias("lift"), F.round(npmi, 6).alias("npmi"))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every pair of entities that share a page, however rare or frequent; a pair on all pages has no npmi."""
    found = pairs.pair_counts(listed_entities(spark, sf_dir), "items")
    npmi = F.ln("lift") / F.nullif(-F.ln(F.col("shared") / F.col("n_records")), F.lit(0.0))
    return found.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "shared", F.round("lift", 6).alias("lift"), F.round(npmi, 6).alias("npmi"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, sizes in bytes of UTF-8, oversized texts cut between characters."""
    sizes = packing.text_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)
    return packing.pack(sizes, "doc", "size", CAPACITY, cuts="cuts").select(F.col("item").alias("doc_id"), "piece", "start", "n", "container", "used")


def p8_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep: the tokens of each document, whether its pieces join without gaps, whether it is whole unless it exceeds a container, and whether all its containers hold what they say and no more than they can."""
    packed = materialise(p8_packed(spark, sf_dir))
    fill = packed.where("container is not null").groupBy(F.col("container").alias("c")).agg(F.sum("n").alias("fill"))
    rows = packed.join(fill, F.col("container") == F.col("c"), "left")
    holds = F.coalesce((F.col("fill") == F.col("used")) & (F.col("fill") <= CAPACITY), F.col("n") == 0)
    found = rows.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.max(F.col("start") + F.col("n")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.bool_and(holds).alias("within"))
    return found.select("doc_id", "tokens", ((F.col("end") == F.col("tokens")) & (F.col("last") == F.col("pieces") - 1)).alias("joined"), ((F.col("pieces") == 1) | (F.col("tokens") > CAPACITY)).alias("whole"), "within")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of at least 15 words of a test item, and the items."""
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document above the limit."""
    cut = pieces.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", LIMIT, OVERLAP)
    return cut.select(F.col("doc").alias("doc_id"), "piece", "start", "stop", "cut")


def p10_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every division must keep: whether the pieces of a document cover it, stay within the limit, and share as many tokens as they must, or up to three more within a character."""
    cut = pieces.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", LIMIT, OVERLAP)
    before = F.lag("stop").over(Window.partitionBy("doc").orderBy("piece"))  # the pieces of one text
    shared = F.coalesce((before - F.col("start")).between(OVERLAP, OVERLAP + 3), F.col("piece") == 0)
    rows = cut.select("doc", "n", "piece", "start", "stop", shared.alias("shared"))
    found = rows.groupBy(F.col("doc").alias("doc_id"), F.col("n").alias("tokens")).agg(((F.min("start") == 0) & (F.max("stop") == F.first("n")) & (F.max("piece") == F.count(F.lit(1)) - 1)).alias("covered"), (F.max(F.col("stop") - F.col("start")) <= LIMIT).alias("within"), F.bool_and("shared").alias("shared"))
    return found.select("doc_id", "tokens", "covered", "within", "shared")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above the limit, and how natural the boundaries are at which they can be cut."""
    cut = pieces.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", LIMIT, OVERLAP)
    return cut.where("piece = 0").select(F.col("doc").alias("doc_id"), F.col("doc_kind").alias("cut_kind"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (p2_found, p2_weights, p3_found, p3_typical, p4_found, p5_found, p5_ngrams, p6_found, p6_lift, p6_pairs, p8_packed, p8_sums, p9_found, p10_found, p10_pieces, p10_cover)}

