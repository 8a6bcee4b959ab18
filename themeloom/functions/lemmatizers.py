"""Pluggable text preprocessing by language: lemmatizers and encoders stay outside, this is where they are plugged in.

A preprocessor is either a function from column to column, which stays in the JVM, or a batch function from a list of texts to a list of texts, made once per Python worker by a
factory. Languages without one leave texts as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

Batch = Callable[[list[str]], list[str]]
_REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(lang: str, f: Callable[[Column], Column]) -> None:
    if not callable(f):
        raise TypeError("a preprocessor must be callable")
    _REGISTRY[lang] = f


def from_factory(factory: Callable[[], Batch]) -> Callable[[Column], Column]:
    """A preprocessor from a factory of batch functions, e.g. one that loads a model; nulls stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        batch = factory()
        for texts in batches:
            done = texts.notna()
            out = texts.copy()
            out[done] = batch(texts[done].tolist())
            yield out

    return run


def preprocess(text: Column, lang: Column) -> Column:
    """The text by the preprocessor of its language."""
    out = text
    for code, f in _REGISTRY.items():
        out = F.when(lang == code, f(text)).otherwise(out)
    return out


def simple(punctuation: bool = False) -> Callable[[Column], Column]:
    """Acronyms without dots and spaces before apostrophes, perhaps before all punctuation: what every lemmatizer here is fed with."""
    return lambda c: T.acronyms(T.space_apostrophes(c, punctuation))


def lemmatizer(lang: str, candidates: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """The preprocessing of a language around a morphology: `candidates` gives the possible lemmas of a word, an array, the word itself without it.

    Words are parted at white space after apostrophes (in Russian all punctuation) have been set apart. The first lemma counts, in Turkish the longest, and there a title word that is among its own
    lemmas stays. Lemmas get the case of their word, Turkish ones lose ablative and plural endings; dots behind capitals go last.
    """
    of = candidates or (lambda w: F.array(w))

    def longest(lemmas: Column) -> Column:
        return F.aggregate(lemmas, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))

    def lemma(word: Column) -> Column:
        lemmas = of(word)
        if lang != "tr":
            return T.restore_case(F.coalesce(F.try_element_at(lemmas, F.lit(1)), word), word, upper_lemma=lang != "ru")
        titles = F.filter(lemmas, T.is_title)
        named = F.when(F.size(titles) > 0, longest(titles)).otherwise(T.title_case(longest(lemmas)))
        own = F.array_contains(F.transform(lemmas, F.lower), F.lower(word))
        return T.turkish_suffixes(F.when(T.is_upper(word) | (T.is_title(word) & own), word).when(T.is_title(word), named).otherwise(F.coalesce(longest(lemmas), word)))

    return lambda text: T.acronyms(F.array_join(F.transform(T.words(T.space_apostrophes(text, lang == "ru")), lemma), " "))


def tagged(docs: DataFrame, doc_id: str, text: str, factory: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]]) -> DataFrame:
    """``(doc_id, start, stop, tag)``: parts of speech by a pluggable tagger of text batches, made once per Python worker; null texts have none."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where("t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = factory()
        for b in batches:
            rows = [(d, *spot) for d, spots in zip(b["doc_id"], tag(b["t"].tolist()), strict=True) for spot in spots]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "tag"])

    return given.mapInPandas(run, "doc_id bigint, start int, stop int, tag string")


def encode(docs: DataFrame, doc_id: str, text: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], max_words: int = 300) -> DataFrame:
    """``(doc_id, vec)`` by a pluggable encoder of text batches, over the first words of each text; empty texts have no vector."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), T.first_words(F.col(text), max_words).alias("t")).where("t <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = factory()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "vec": f(b["t"].tolist()) if len(b) else []})

    return given.mapInPandas(run, "doc_id bigint, vec array<double>")
