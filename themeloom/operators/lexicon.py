"""The lexicon: per language, which surface forms stand for which entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .kb import KnowledgeBase

FALLBACK = "en"
#: A preprocessor of keys: key and language to key, see `functions.lemmatizers.preprocess`.
Prepare = Callable[[Column, Column], Column]


def _prepared(prepare: Prepare | None, key: Column, lang: Column) -> Column:
    return key if prepare is None else prepare(key, lang)


def _variants(prepare: Prepare | None, label: Column, lang: Column) -> Column:
    """Case variants of a label, and each of them preprocessed."""
    plain = T.case_variants(label)
    return plain if prepare is None else F.array_distinct(F.concat(plain, F.array(*[prepare(F.get(plain, F.lit(i)), lang) for i in range(4)])))


def surface_forms(kb: KnowledgeBase, langs: list[str], spaced_classes: list[int], translations: DataFrame | None = None, min_length: int = 4, prepare: Prepare | None = None) -> DataFrame:
    """``(lang, key, num, ord)``: labels and aliases of every entity in every language that are usable keys.

    An entity without a label in a language lends its English label and aliases, each also in its translation, if `translations(lang, label, translation)` has
    one. `ord` puts an entity's label before its aliases. `prepare` rewrites keys, as the texts are rewritten that they are looked for in.
    """
    wanted = F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")
    english = kb.labels.where(F.col("lang") == FALLBACK).select("num", F.col("label").alias("en"))
    pairs = kb.entities.select("num", wanted).join(kb.labels, ["num", "lang"], "left").join(english, "num", "left").where("label is not null or en is not null")
    lent = pairs.where("label is null").select("num", "lang")
    own = pairs.where("label is not null").select("num", "lang", F.col("label").alias("key"), F.lit(-1).cast("bigint").alias("pos"))
    own_aliases = kb.aliases.where(F.col("lang").isin(*langs)).join(pairs.where("label is not null").select("num", "lang"), ["num", "lang"], "left_semi").select("num", "lang", F.col("alias").alias("key"), "pos")
    lent_labels = lent.join(english, "num").select("num", "lang", F.col("en").alias("key"), F.lit(-1).cast("bigint").alias("pos"))
    lent_aliases = lent.join(kb.aliases.where(F.col("lang") == FALLBACK).select("num", F.col("alias").alias("key"), "pos"), "num").select("num", "lang", "key", "pos")
    if translations is not None:
        t = translations.groupBy("lang", F.col("label").alias("key")).agg(F.min("translation").alias("translation"))
        lent_labels = lent_labels.join(t, ["lang", "key"], "left").select("num", "lang", F.coalesce("translation", "key").alias("key"), "pos")
        both = lent_aliases.join(t, ["lang", "key"], "left").select("num", "lang", F.explode(F.array_distinct(F.array(F.col("key"), F.coalesce("translation", "key")))).alias("key"), "pos")
        lent_aliases = both
    spaced = kb.properties.where((F.col("property") == "instance_of") & F.col("value").isin(*spaced_classes)).select("num").distinct().withColumn("spaced", F.lit(True))
    every = own.unionByName(own_aliases).unionByName(lent_labels).unionByName(lent_aliases).join(spaced, "num", "left")
    every = every.withColumn("key", _prepared(prepare, F.col("key"), F.col("lang")))
    kept = every.where(T.valid_key(F.col("key"), F.col("pos") < 0, F.coalesce("spaced", F.lit(False)), min_length))
    return kept.select("lang", "key", "num", F.col("pos").alias("ord"))


def removed(forms: DataFrame, labels: DataFrame, langs: list[str], prepare: Prepare | None = None) -> DataFrame:
    """`forms` without every case variant of `labels(lang, label)`, lang ``all`` counting for each language."""
    code = F.when(F.col("lang") == "all", F.array(*[F.lit(x) for x in langs])).otherwise(F.array("lang"))
    each = labels.where("label <> ''").select(F.explode(code).alias("lang"), "label").select("lang", F.explode(_variants(prepare, F.col("label"), F.col("lang"))).alias("key")).distinct()
    return forms.join(each, ["lang", "key"], "left_anti")


def posting_lists(forms: DataFrame) -> DataFrame:
    """``(lang, key, ids)``: the entities of each key in ascending order, as often as the entity gives the key."""
    return forms.groupBy("lang", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "ord"))), lambda x: x["num"]).alias("ids"))


def patched(lexicon: DataFrame, patches: DataFrame, kb: KnowledgeBase, langs: list[str], prepare: Prepare | None = None) -> DataFrame:
    """`lexicon` with the case variants of `patches(lang, alias, num)` standing for the patch's entity alone, if the knowledge base has it.

    A patch for a language goes before one for ``all``; among several for the same key the lowest entity wins. Patches also bring back removed keys.
    """
    there = patches.where("alias <> '' and num is not null").join(kb.entities, "num", "left_semi")
    code = F.when(F.col("lang") == "all", F.array(*[F.lit(x) for x in langs])).otherwise(F.array("lang"))
    keyed = there.select(F.explode(code).alias("lang"), (F.col("lang") == "all").alias("general"), "alias", "num").where(F.col("lang").isin(*langs))
    best = keyed.select("lang", "general", "num", F.explode(_variants(prepare, F.col("alias"), F.col("lang"))).alias("key")).groupBy("lang", "key").agg(F.min(F.struct("general", "num")).alias("best"))
    best = best.select("lang", "key", F.array("best.num").alias("ids"))
    return lexicon.join(best, ["lang", "key"], "left_anti").unionByName(best)


def dictionary(lexicon: DataFrame, lang: str) -> DataFrame:
    """``(key, key_id)``: the keys of a language, numbered from 0 in their order by digest, without sorting them in one task."""
    from .corpus import ranked

    keys = lexicon.where(F.col("lang") == lang).select("key").distinct().withColumn("pos", F.col("key"))
    return ranked(keys, F.md5("key")).select("key", F.col("rank").alias("key_id"))
