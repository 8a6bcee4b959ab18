"""The knowledge base as related flat tables, and the filters, joins and counts over it.

All tables are in long form, a row per label, alias or property value; entities are numbers. No operator gathers an entity's rows, so hub entities cost no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import entity_number
from ..session import materialise
from . import nested
from .states import latest_state

#: The classes whose entities need names of more than one word, and the properties that decide on relevance.
GATE_PROPERTIES = ("instance_of", "facet_of", "subclass_of")


@dataclass
class KnowledgeBase:
    """``entities(num)``, ``labels(num, lang, label)``, ``descriptions(num, lang, description)``, ``aliases(num, lang, pos, alias)``, ``properties(num, property, pos, value)``, ``titles(num, enwiki)``."""

    entities: DataFrame
    labels: DataFrame
    descriptions: DataFrame
    aliases: DataFrame
    properties: DataFrame
    titles: DataFrame


def summarise(records: DataFrame, cut: bool = True) -> KnowledgeBase:
    """The current state of every entity of the JSON records, flattened. Damaged fields give nothing, of several labels in one language the first counts."""
    fields = ["labels", "descriptions", "aliases", "properties"]
    current = latest_state(records, entity_number("id"), "seen_at", "rec_no", {c: F.col(c) for c in [*fields, "enwiki"]})
    current = materialise(current) if cut else current
    items = nested.items(nested.shred(current, "key", fields, leaves_only=True))
    items = materialise(items) if cut else items
    of = lambda field: items.where(F.col("field") == field)
    first = lambda field, name: of(field).groupBy(F.col("rec").alias("num"), F.col("item_key").alias("lang")).agg(F.min_by("item", "item_pos").alias(name))
    return KnowledgeBase(
        current.select(F.col("key").alias("num")),
        first("labels", "label"),
        first("descriptions", "description"),
        of("aliases").select(F.col("rec").alias("num"), F.col("item_key").alias("lang"), F.col("item_pos").alias("pos"), F.col("item").alias("alias")),
        of("properties").select(F.col("rec").alias("num"), F.col("item_key").alias("property"), F.col("item_pos").alias("pos"), entity_number("item").alias("value")).where("value is not null"),
        current.select(F.col("key").alias("num"), "enwiki"),
    )


def restricted(kb: KnowledgeBase, nums: DataFrame) -> KnowledgeBase:
    """The part of the knowledge base about `nums(num)`, parentheses cut off labels and aliases with one left out."""
    of = lambda df: df.join(nums.select("num").distinct(), "num", "left_semi")
    labels = of(kb.labels).withColumn("label", T.without_parenthesis(F.col("label")))
    return KnowledgeBase(of(kb.entities), labels, of(kb.descriptions), of(kb.aliases).where(F.instr("alias", "(") == 0), of(kb.properties), of(kb.titles))


def usable(kb: KnowledgeBase) -> DataFrame:
    """``(num)`` of the entities with an English label that is no number, and an English description."""
    named = kb.labels.where((F.col("lang") == "en") & ~T.is_number(F.col("label"))).select("num")
    return named.join(kb.descriptions.where("lang = 'en'").select("num"), "num", "left_semi")


def gated(kb: KnowledgeBase, relevant: DataFrame, bypass: DataFrame) -> DataFrame:
    """``(num)`` of the entities with a relevant value in one of the gate properties - `relevant(property, value)` - or in `bypass(num)`."""
    hit = kb.properties.join(relevant.select("property", "value"), ["property", "value"], "left_semi").select("num")
    return kb.entities.join(hit.union(bypass.select("num")).distinct(), "num", "left_semi")


def by_property_values(kb: KnowledgeBase, wanted: DataFrame, include_values: bool = False) -> DataFrame:
    """``(num)`` of the entities with a property value in `wanted(property, value)`; with `include_values` also of the values themselves."""
    hit = kb.properties.join(wanted, ["property", "value"], "left_semi").select("num")
    return kb.entities.join((hit.union(wanted.select(F.col("value").alias("num"))) if include_values else hit).distinct(), "num", "left_semi")


def top_ranked(qrank: DataFrame, n: int, added: DataFrame) -> DataFrame:
    """``(num)`` of the `n` most popular entities (ties by the lower number) and of those of `added(num)`."""
    best = qrank.select(entity_number("entity").alias("num"), "qrank").where("num is not null").groupBy("num").agg(F.max("qrank").alias("qrank"))
    return best.orderBy(F.desc_nulls_last("qrank"), "num").limit(n).select("num").union(added.select("num")).distinct()


def property_counts(kb: KnowledgeBase, properties: tuple[str, ...] = GATE_PROPERTIES) -> DataFrame:
    """``(property, value, label, n)``: how many entities with an English label name the value; the value's English label, or its id where there is none."""
    english = kb.labels.where("lang = 'en'").select("num", "label")
    named = kb.properties.where(F.col("property").isin(*properties)).join(english.select("num"), "num", "left_semi")
    counts = named.groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(english.select(F.col("num").alias("value"), "label"), "value", "left").select("property", "value", F.coalesce("label", F.concat(F.lit("Q"), "value")).alias("label"), "n")


def merge_curated(counts: DataFrame, curated: DataFrame) -> DataFrame:
    """New counts with the curated columns of an older table `curated(value, relevant)`: ``1`` where positive, else empty."""
    old = curated.groupBy("value").agg(F.max("relevant").alias("relevant"))
    return counts.join(old, "value", "left").select(*counts.columns, F.when(F.col("relevant") > 0, "1").otherwise("").alias("relevant"))


def relevant_values(curated: DataFrame) -> DataFrame:
    """``(property, value)`` of the rows whose mark isn't empty or zero."""
    return curated.where("coalesce(relevant, '') not in ('', '0')").select("property", "value")


def smallest_by_label(kb: KnowledgeBase, lang: str) -> DataFrame:
    """``(label, num)``: for each label of a language the lowest entity that has it."""
    return kb.labels.where(F.col("lang") == lang).groupBy("label").agg(F.min("num").alias("num"))


def translated(rows: DataFrame, num: str, kb: KnowledgeBase, lang: str, missing: str = "<NO TRANSLATION>") -> DataFrame:
    """`rows` with the label of the entity in the column `num`, as column `label`."""
    names = kb.labels.where(F.col("lang") == lang).select(F.col("num").alias("_of"), "label")
    return rows.join(names, F.col(num) == F.col("_of"), "left").select(*[rows[c] for c in rows.columns if c != "label"], F.coalesce(names["label"], F.lit(missing)).alias("label"))


def edges(kb: KnowledgeBase, text_entities: DataFrame | None = None) -> DataFrame:
    """``(src, dst)``: distinct links from entities to their property values, with `text_entities(num, value)` also to those; none to themselves."""
    links = kb.properties.select(F.col("num").alias("src"), F.col("value").alias("dst"))
    if text_entities is not None:
        links = links.union(text_entities.select("num", "value"))
    return links.where("src <> dst").distinct()


def listed_or_own(num: Column, listed: Column) -> Column:
    """The entities listed for a page, or the page's own where there is no list."""
    return F.coalesce(listed, F.array(num))


def to_translate(kb: KnowledgeBase, lang: str, people: int, with_people: bool = False, min_length: int = 4) -> DataFrame:
    """``(text)``: English labels, and aliases of other than people, of entities without a label in `lang`: long enough, with a space, not in upper case."""
    human = kb.properties.where((F.col("property") == "instance_of") & (F.col("value") == people)).select("num").distinct()
    lacking = kb.entities.join(kb.labels.where(F.col("lang") == lang).select("num"), "num", "left_anti")
    lacking = lacking if with_people else lacking.join(human, "num", "left_anti")
    texts = kb.labels.where("lang = 'en'").select("num", F.col("label").alias("text")).union(kb.aliases.where("lang = 'en'").join(human, "num", "left_anti").select("num", "alias"))
    kept = (F.length("text") >= min_length) & (F.instr("text", " ") > 0) & ~T.is_upper(F.col("text"))
    return texts.join(lacking, "num", "left_semi").where(kept).select("text").distinct()


def page_titles(kb: KnowledgeBase) -> DataFrame:
    """``(title, num)``: the entity of a page title; exact titles go before those in title case, those before lower case, English labels come last; among equals the lowest entity."""
    title = F.translate("enwiki", "_", " ")
    t = kb.titles.where("enwiki is not null and enwiki <> ''")
    keyed = t.select(title.alias("title"), "num", F.lit(0).alias("prio")).union(t.select(T.title_case(title), "num", F.lit(1))).union(t.select(F.lower(title), "num", F.lit(2))).union(kb.labels.where("lang = 'en'").select("label", "num", F.lit(3)))
    return keyed.groupBy("title").agg(F.min_by("num", F.struct("prio", "num")).alias("num"))


def by_ids(kb: KnowledgeBase, ids: DataFrame, at_most: int | None = None) -> KnowledgeBase:
    """The part of the knowledge base about `ids(num)`; with `at_most` only about the lowest so many."""
    nums = kb.entities.join(ids.select("num").distinct(), "num", "left_semi")
    return restricted(kb, nums if at_most is None else nums.orderBy("num").limit(at_most))


def usable_translations(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    """`pairs(lang, label, translation)` without English labels that are removed for English and translations that are removed for their language; `removed(lang, label)`, ``all`` counting for each."""
    english = removed.where("lang in ('en', 'all')").select("label").distinct()
    own = removed.where("lang <> 'all'").select("lang", F.col("label").alias("translation"))
    every = removed.where("lang = 'all'").select(F.col("label").alias("translation")).distinct()
    return pairs.join(english, "label", "left_anti").join(own, ["lang", "translation"], "left_anti").join(every, "translation", "left_anti").select("lang", "label", "translation")


def embedding_texts(kb: KnowledgeBase, pages: DataFrame, words: int = 300, lang: str = "en") -> DataFrame:
    """``(num, text)`` for an encoder: the first words of an entity's page, `pages(num, text)`, or its label and description where it has no page with a text."""
    paged = pages.where("num is not null and trim(text) <> ''").select("num", T.first_words(F.col("text"), words).alias("text"))
    of = lambda df: df.where(F.col("lang") == lang).drop("lang")
    described = of(kb.labels).join(of(kb.descriptions), "num", "left").join(paged.select("num"), "num", "left_anti")
    return paged.unionByName(described.select("num", T.description_of(F.col("label"), F.col("description")).alias("text")))
