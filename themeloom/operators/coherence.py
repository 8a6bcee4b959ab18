"""Topic quality: diversity, and coherence from words that stand together.

Tokens are ``(doc, pos, tok)`` rows, topics ``(topic, place, num)`` words. Only words of topics, and only pairs of words of one topic, are ever paired, so a document gives at most as many
pairs as its topics have, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

EPS = 1e-12
MEASURES = ("npmi", "pmi", "lc")


def diversity(topics: DataFrame, words: int = 25) -> DataFrame:
    """``(diversity)``: distinct words over words, among the first `words` of every topic."""
    return topics.where(F.col("place") <= words).agg(F.try_divide(F.count_distinct("num").cast("double"), F.count("num")).alias("diversity"))


def word_pairs(topics: DataFrame, words: int) -> DataFrame:
    """``(topic, w1, w2)``: all pairs of the first words of each topic, w1 the higher placed; a topic has a bounded number of words."""
    a = topics.where(F.col("place") <= words).select("topic", F.col("place").alias("p1"), F.col("num").alias("w1"))
    b = a.select("topic", F.col("p1").alias("p2"), F.col("w1").alias("w2"))
    return a.join(b, "topic").where("p1 < p2").select("topic", "w1", "w2")


def _pair_counts(units: DataFrame, topics: DataFrame, words: int) -> DataFrame:
    """``(lo, hi, n)``: in how many units two words of one topic stand together; `units(unit, tok)`."""
    vocabulary = topics.where(F.col("place") <= words).select("topic", "num")
    hits = units.join(vocabulary, F.col("tok") == F.col("num")).select("unit", "topic", "num").distinct()
    other = hits.select("unit", "topic", F.col("num").alias("hi"))
    return hits.join(other, ["unit", "topic"]).where("num < hi").select("unit", F.col("num").alias("lo"), "hi").distinct().groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(tok, n)``: occurrences over the corpus."""
    return tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def pair_scores(tokens: DataFrame, topics: DataFrame, words: int = 10) -> DataFrame:
    """``(topic, w1, w2, npmi, pmi, lc)`` with base-2 logarithms.

    Words count by occurrences, pairs by documents, both over the total number of tokens; what never occurs counts once.
    """
    total = F.lit(float(tokens.count() or 1))
    n = token_counts(tokens)
    pairs = word_pairs(topics, words).withColumn("lo", F.least("w1", "w2")).withColumn("hi", F.greatest("w1", "w2"))
    shared = _pair_counts(tokens.select(F.col("doc").alias("unit"), "tok"), topics, words).withColumnRenamed("n", "n12")
    of = lambda w, name: n.select(F.col("tok").alias(w), F.col("n").alias(name))
    rows = pairs.join(shared, ["lo", "hi"], "left").join(of("w1", "n1"), "w1", "left").join(of("w2", "n2"), "w2", "left")
    p1, p2, p12 = (F.coalesce(c, F.lit(1)) / total for c in ("n1", "n2", "n12"))
    pmi = F.log2(p12 / (p1 * p2))
    return rows.select("topic", "w1", "w2", F.try_divide(pmi, -F.log2(p12)).alias("npmi"), pmi.alias("pmi"), F.log2(p12 / p2).alias("lc"))


def topic_coherence(scores: DataFrame, measure: str) -> DataFrame:
    """``(topic, coherence)``: the mean of the measure over the topic's pairs."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {', '.join(MEASURES)}")
    return scores.groupBy("topic").agg(F.avg(measure).alias("coherence"))


def windows(tokens: DataFrame, size: int) -> DataFrame:
    """``(unit, tok)``: the sliding windows of `size` tokens; a shorter document is one window. A unit is named by document and number."""
    length = tokens.groupBy(F.col("doc").alias("d")).agg(F.max("pos").alias("last"))
    rows = tokens.join(length, F.col("doc") == F.col("d"))
    n = F.greatest(F.col("last") - size + 1, F.lit(1))
    inside = F.sequence(F.greatest(F.col("pos") - size + 1, F.lit(1)), F.least(F.col("pos"), n))
    return rows.select("doc", "tok", F.explode(inside).alias("w")).select(F.struct("doc", "w").alias("unit"), "tok").distinct()


def _together(docs: DataFrame, size: int) -> DataFrame:
    """``(lo, hi, n)``: in how many windows of `size` tokens two words stand together, for a word with itself in how many it stands; `docs(doc, last, hits)`, hits being places and words.

    A hit is paired with those less than `size` places behind it. Words recur within a window, so of each document the windows of a pair are counted as a set: an interval of windows for each two places.
    """
    n = F.greatest(F.col("last") - size + 1, F.lit(1))
    behind = lambda h, i: F.filter(F.slice("hits", i + 1, F.lit(size)), lambda o: o["pos"] < h["pos"] + size)
    two = F.flatten(F.transform("hits", lambda h, i: F.transform(behind(h, i), lambda o: F.struct(F.least(h["w"], o["w"]).alias("lo"), F.greatest(h["w"], o["w"]).alias("hi"), F.greatest(o["pos"] - size + 1, F.lit(1)).alias("first"), F.least(h["pos"], n).alias("final")))))
    spans = docs.select("doc", F.explode(two).alias("t")).select("doc", "t.*").where((F.col("lo") != F.col("hi")) | (F.col("final") >= F.col("first")))
    # a pair's intervals within a document, from left to right: each adds what those before it haven't covered
    each = spans.groupBy("doc", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("first", "final"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")), lambda a, x: F.struct((a["n"] + F.greatest(x["final"] - F.greatest(a["upto"], x["first"] - 1), F.lit(0))).alias("n"), F.greatest(a["upto"], x["final"].cast("bigint")).alias("upto")), lambda a: a["n"])
    return materialise(each.select("lo", "hi", covered.alias("n")).groupBy("lo", "hi").agg(F.sum("n").alias("n")).where("n > 0"))


def window_coherence(tokens: DataFrame, topics: DataFrame, words: int = 10, size: int = 10) -> DataFrame:
    """``(topic, c_npmi, c_uci)`` over sliding windows with natural logarithms and a small constant for pairs that never meet."""
    vocabulary = topics.where(F.col("place") <= words).select(F.col("num").alias("word")).distinct()
    marked = tokens.join(F.broadcast(vocabulary), F.col("tok") == F.col("word"), "left")  # the first words of topics, a bounded number
    docs = materialise(marked.groupBy("doc").agg(F.max("pos").alias("last"), F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", F.col("word").alias("w"))))).alias("hits")))
    total = F.lit(float(docs.agg(F.sum(F.greatest(F.col("last") - size + 1, F.lit(1)))).first()[0] or 1))
    counts = _together(docs, size)
    pairs = word_pairs(topics, words).withColumn("lo", F.least("w1", "w2")).withColumn("hi", F.greatest("w1", "w2"))
    of = lambda w, name: counts.where("lo = hi").select(F.col("lo").alias(w), F.col("n").alias(name))
    rows = pairs.join(counts.withColumnRenamed("n", "n12"), ["lo", "hi"], "left").join(of("w1", "n1"), "w1").join(of("w2", "n2"), "w2")
    p12 = F.coalesce("n12", F.lit(0)) / total
    uci = F.ln((p12 + EPS) / ((F.col("n1") / total) * (F.col("n2") / total)))
    return rows.select("topic", uci.alias("u"), (uci / -F.ln(p12 + EPS)).alias("v")).groupBy("topic").agg(F.avg("v").alias("c_npmi"), F.avg("u").alias("c_uci"))


def umass(tokens: DataFrame, topics: DataFrame, words: int = 10) -> DataFrame:
    """``(topic, u_mass)`` over documents: the logarithm of the share of the higher placed word's documents that have both."""
    total = F.lit(float(tokens.select("doc").distinct().count() or 1))
    seen = tokens.select(F.col("doc").alias("unit"), "tok").distinct()
    counts = seen.groupBy(F.col("tok").alias("w1")).agg(F.count(F.lit(1)).alias("n1"))
    pairs = word_pairs(topics, words).withColumn("lo", F.least("w1", "w2")).withColumn("hi", F.greatest("w1", "w2"))
    rows = pairs.join(_pair_counts(seen, topics, words), ["lo", "hi"], "left").join(counts, "w1")
    return rows.select("topic", F.ln((F.coalesce("n", F.lit(0)) / total + EPS) / (F.col("n1") / total)).alias("m")).groupBy("topic").agg(F.avg("m").alias("u_mass"))


def statistics(tokens: DataFrame, topics: DataFrame, diversity_words: int = 25, words: int = 10) -> DataFrame:
    """One row: diversity, the three coherences averaged over topics, and each times the diversity, to four decimals."""
    d = diversity(topics, diversity_words)
    c = window_coherence(tokens, topics, words).agg(F.avg("c_npmi").alias("c_npmi"), F.avg("c_uci").alias("c_uci"))
    u = umass(tokens, topics, words).agg(F.avg("u_mass").alias("u_mass"))
    one = d.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").join(u.withColumn("one", F.lit(1)), "one")
    r = lambda e: F.round(e, 4)
    q = [r(F.col(m) * F.col("diversity")).alias(f"quality_{m}") for m in ("c_npmi", "c_uci", "u_mass")]
    return one.select(r(F.col("diversity")).alias("diversity"), *[r(F.col(m)).alias(m) for m in ("c_npmi", "c_uci", "u_mass")], *q)
