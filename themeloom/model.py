"""The two objects most programs need: a matcher that turns texts into entities, and a topic model over entities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import coherence as H
from .operators import disambiguate as D
from .operators import kb as K
from .operators import lexicon as L
from .operators import matching as M
from .operators import reports as R
from .operators import topics as T
from .operators import vectors as V
from .session import materialise
from .sources import files


@dataclass
class EntityMatcher:
    """A knowledge base, its lexicon and its entities' vectors."""

    kb: K.KnowledgeBase
    lexicon: DataFrame
    vectors: DataFrame
    dims: int
    langs: list[str]
    threshold: float = 0.5

    @classmethod
    def fit(cls, kb: K.KnowledgeBase, vectors: DataFrame, dims: int, langs: list[str], spaced_classes: list[int], removed: DataFrame | None = None, patches: DataFrame | None = None, translations: DataFrame | None = None, min_length: int = 4, threshold: float = 0.5) -> EntityMatcher:
        """Builds the lexicon; English is always among the languages."""
        langs = sorted({*langs, L.FALLBACK})
        forms = L.surface_forms(kb, langs, spaced_classes, translations, min_length)
        if removed is not None:
            forms = L.removed(forms, removed, langs)
        lexicon = L.posting_lists(forms)
        if patches is not None:
            lexicon = L.patched(lexicon, patches, kb, langs)
        return cls(kb, materialise(lexicon), vectors, dims, langs, threshold)

    def tokenize(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", overlaps: bool = False) -> DataFrame:
        """Mentions of keys, ``(doc_id, start, stop, key)``."""
        return M.mentions(docs, doc_id, text, lang, self.lexicon, overlaps=overlaps)

    def entities_of(self, keys: DataFrame) -> DataFrame:
        """``keys(lang, key)`` with their ids, an empty list for unknown ones."""
        return keys.join(self.lexicon, ["lang", "key"], "left").select("lang", "key", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))

    def entitize(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", extend: bool = False, threshold: float | None = None, at_least: int = 1, doc_vectors: DataFrame | None = None) -> DataFrame:
        """Bags of entities, ``(doc_id, num, n)``; the documents' vectors are the candidates' means unless an encoder's are given."""
        t = self.threshold if threshold is None else threshold
        code = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), "[-_].*$", "")
        langs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.when(code.isin(*self.langs), code).otherwise(L.FALLBACK).alias("lang"))
        cands = materialise(D.candidates(self.tokenize(docs, doc_id, text, lang), langs, self.lexicon))
        vectors = D.mean_of_candidates(cands, self.vectors, self.dims) if doc_vectors is None else doc_vectors
        vectors = materialise(vectors)
        picked = D.chosen(cands, D.scored(cands, vectors, self.vectors, t))
        if extend:
            picked = D.extended(picked, self.kb.properties, vectors, self.vectors, t)
        return D.bags(picked, at_least)

    def save(self, path: str) -> None:
        for name in ("entities", "labels", "descriptions", "aliases", "properties", "titles"):
            getattr(self.kb, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: int, threshold: float = 0.5) -> EntityMatcher:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        kb = K.KnowledgeBase(*[read(n) for n in ("entities", "labels", "descriptions", "aliases", "properties", "titles")])
        lexicon = read("lexicon")
        langs = sorted(r.lang for r in lexicon.select("lang").distinct().collect())
        return cls(kb, lexicon, read("vectors"), dims, langs, threshold)


@dataclass
class TopicModel:
    """Topics of entities: ``words(topic, place, num, score)`` and one centroid per topic."""

    words: DataFrame
    centroids: np.ndarray
    labels: dict[int, str] = field(default_factory=dict)

    @classmethod
    def train(cls, vectors: DataFrame, num_topics: int, iterations: int = 300, num_words: int = 500, seed: int | None = None, entities: DataFrame | None = None, top_entities: DataFrame | None = None) -> TopicModel:
        """Clusters the vectors of `entities(num)` (all without) and takes topic words from `top_entities(num)` (the same without).

        Without a seed the start is the lowest entities, with one a choice fixed by it.
        """
        given = vectors if entities is None else vectors.join(entities.select("num").distinct(), "num", "left_semi")
        given = materialise(given.select("num", "vec"))
        if seed is None:
            start = T.start_vectors(given, num_topics)
        else:
            start = np.array([r.vec for r in given.orderBy(F.xxhash64("num", F.lit(seed)), "num").limit(num_topics).collect()], float)
        if len(start) < num_topics:
            raise ValueError("fewer entities than topics")
        centroids = T.lloyd(given, start, iterations)
        among = given if top_entities is None else given.join(top_entities.select("num").distinct(), "num", "left_semi")
        return cls(materialise(T.topic_words(among, centroids, num_words)), centroids)

    def fit(self, *_: object) -> None:
        raise NotImplementedError("topics are made by train()")

    def perplexity(self, *_: object) -> float:
        raise NotImplementedError("clusters have no likelihood")

    @property
    def num_topics(self) -> int:
        return len(self.centroids)

    def label(self, topic: int) -> str:
        return self.labels.get(topic, str(topic))

    def topic(self, topic: int, num_words: int = 0) -> DataFrame:
        """A topic's words, all for 0; none for a negative topic."""
        rows = self.words.where(F.col("topic") == topic) if topic >= 0 else self.words.limit(0)
        return rows.where(F.col("place") <= num_words) if num_words > 0 else rows

    def topics(self, num_words: int = 10) -> DataFrame:
        return self.words.where(F.col("place") <= num_words)

    def inference(self, bags: DataFrame, vectors: DataFrame, n: int | None = None) -> DataFrame:
        """``(doc_id, topic, d2, prob, place)`` of the bags ``(doc_id, num, n)``, of the nearest `n` topics or all; documents without an entity with a vector have no rows."""
        means = V.weighted_mean(bags.join(vectors, "num").select("doc_id", "vec", "n"), "doc_id", "vec", self.centroids.shape[1], "n")
        return T.document_topics(means, self.centroids, n=n)

    def transform(self, bags: DataFrame, vectors: DataFrame) -> DataFrame:
        """``(doc_id, topic)``: the nearest topic, -1 where there is none."""
        return T.best_topic(bags, self.inference(bags, vectors, 1))

    def predict(self, spark: SparkSession, entities: list[int], vectors: DataFrame) -> dict[int, float]:
        """Probabilities of all topics for one list of entities, the nearest first."""
        bag = spark.createDataFrame([(0, e) for e in entities], "doc_id bigint, num bigint").groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"))
        return {r.topic: r.prob for r in self.inference(bag, vectors).orderBy("place").collect()}

    def top_topics(self, bags: DataFrame, vectors: DataFrame, n: int = 3) -> DataFrame:
        return self.inference(bags, vectors, n)

    def update_top_words(self, bags: DataFrame, vectors: DataFrame, top_topics: int = 1, num_words: int = 1000) -> TopicModel:
        """A model with topic words from a corpus of bags."""
        total = bags.groupBy("doc_id").agg(F.sum("n").alias("t"))
        freqs = bags.join(total, "doc_id").select("doc_id", "num", (F.col("n") / F.col("t")).alias("freq"))
        return TopicModel(materialise(T.refreshed_words(freqs, self.inference(bags, vectors, top_topics), self.words, top_topics, num_words)), self.centroids, self.labels)

    def coherence(self, tokens: DataFrame, measure: str = "npmi", num_words: int = 10) -> float:
        """The mean over topics; ``c_npmi``, ``c_uci`` and ``u_mass`` are known besides the measures with base-2 logarithms."""
        if measure in ("c_npmi", "c_uci"):
            scores = H.window_coherence(tokens, self.words, num_words).select(measure)
        elif measure == "u_mass":
            scores = H.umass(tokens, self.words, num_words).select(measure)
        else:
            scores = H.topic_coherence(H.pair_scores(tokens, self.words, num_words), measure).select("coherence")
        return scores.agg(F.avg(scores.columns[0])).first()[0]

    def diversity(self, num_words: int = 25) -> float:
        return H.diversity(self.words, num_words).first().diversity

    def statistics(self, tokens: DataFrame) -> DataFrame:
        return H.statistics(tokens, self.words)

    def to_dataframe(self, kb: K.KnowledgeBase, num_words: int = 10, lang: str = "en", min_score: float = 1e-4) -> DataFrame:
        return R.wide(K.translated(self.words, "num", kb, lang), num_words, min_score)

    def to_json(self, kb: K.KnowledgeBase, num_words: int = 25, lang: str = "en") -> DataFrame:
        return R.as_json(K.translated(self.words, "num", kb, lang), num_words)

    def to_markdown(self, kb: K.KnowledgeBase, num_words: int = 10, lang: str = "en") -> DataFrame:
        return R.as_markdown(K.translated(self.words, "num", kb, lang), num_words)

    def save(self, path: str) -> None:
        files.save_model(self.words, self.centroids.tolist(), path, labels={str(k): v for k, v in self.labels.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        words, centroids, parameters = files.load_model(spark, path)
        return cls(words, np.array(centroids) if centroids else np.empty((0, 0)), {int(k): v for k, v in parameters["labels"].items()})

    @classmethod
    def from_sheet(cls, spark: SparkSession, path: str, vectors: DataFrame, dims: int, min_score: float = 1e-4, min_words: int = 1) -> TopicModel:
        """A model from a sheet of topics: scores add up to 1 per topic, a centroid is the mean of its words' vectors weighted by them. Topics none of whose words has a vector are refused."""
        from .functions.ids import entity_number

        sheet = materialise(files.read_topics_sheet(spark, path, min_score, min_words).withColumn("num", entity_number("id")).where("num is not null"))
        total = sheet.groupBy("topic").agg(F.sum("score").alias("t"))
        words = materialise(sheet.join(total, "topic").select("topic", "place", "num", (F.col("score") / F.col("t")).alias("score")))
        means = {r.topic: r.vec for r in V.weighted_mean(words.join(vectors, "num"), "topic", "vec", dims, "score").collect()}
        names = {r.topic: r.label for r in sheet.select("topic", "label").distinct().collect()}
        if means.keys() != names.keys():
            raise ValueError("topics without a vector: " + ", ".join(str(t) for t in sorted(names.keys() - means.keys())))
        order = sorted(names)
        if not order:
            return cls(words, np.empty((0, 0)))
        place = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])
        return cls(words.withColumn("topic", place[F.col("topic")]), np.array([means[t] for t in order]), {i: names[t] for i, t in enumerate(order)})
