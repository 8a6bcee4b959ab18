"""Knowledge-base queries: validity, filters, counts, joins, lexicon, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import entity_number, entity_numbers
from ..operators import kb as K
from ..operators import lexicon as L
from ..operators import pages as P
from ..operators.states import latest_state
from . import sql as Q
from .catalog import query, table

LANGS = ["en", "fr", "de", "es"]
PEOPLE = 101  # the class of people in the test tables
_LANGS = "['en', 'fr', 'de', 'es']"

_NUMBER = "(regexp_full_match(trim(regexp_replace(replace({0}, ',', '.'), '%+$', '')), '[+-]?((\\d+(_\\d+)*)?\\.?\\d+(_\\d+)*|\\d+(_\\d+)*\\.)([eE][+-]?\\d+)?') or lower(trim(regexp_replace(replace({0}, ',', '.'), '%+$', ''))) in ('nan', 'inf', 'infinity', '+nan', '-nan', '+inf', '-inf', '+infinity', '-infinity'))"
_VALID_LABEL = """({0} <> '' and instr({0}, '(') = 0 and instr({0}, ' - ') = 0 and regexp_full_match({0}, '[^!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~].*[a-zA-Z].+'))"""
_UPPER = "(upper({0}) = {0} and lower({0}) <> {0})"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _variants(x: str) -> str:
    return f"list_distinct([lower({x}), upper({x}), {_title(x)}, upper({x}[1]) || {x}[2:]])"


def knowledge(spark: SparkSession, sf_dir: str) -> K.KnowledgeBase:
    return K.summarise(table(spark, sf_dir, "wikidata_summary"))


@query(f"with {Q.KB} select num, label, {_VALID_LABEL.format('label')} as valid from labels_ where lang = 'en'")
def kb_label_valid(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    return kb.labels.where("lang = 'en'").select("num", "label", T.valid_label(F.col("label")).alias("valid"))


@query("with n as (select p_partkey, case p_partkey % 6 when 0 then p_partkey::varchar when 1 then replace(p_retailprice::decimal(12, 2)::varchar, '.', ',') || '%' when 2 then p_size || '.5.1' when 3 then 'nan' when 4 then p_name else p_size || 'e3' end as label from part) select p_partkey, label, " + _NUMBER.format("label") + " as numeric from n")
def numeric_label_drop(spark, sf_dir):
    k = F.col("p_partkey") % 6
    label = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat(F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("%"))).when(k == 2, F.concat("p_size", F.lit(".5.1"))).when(k == 3, "nan").when(k == 4, F.col("p_name")).otherwise(F.concat("p_size", F.lit("e3")))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select("p_partkey", "label", T.is_number(F.col("label")).alias("numeric"))


_FORMS = f"""good as (select num from labels_ where lang = 'en' and not {_NUMBER.format('label')} and {_VALID_LABEL.format('label')} and num in (select num from descriptions_ where lang = 'en')),
lab as (select num, lang, split_part(label, ' (', 1) as label from labels_ where num in (select num from good)), ali as (select * from aliases_ where num in (select num from good) and instr(alias, '(') = 0),
langs as (select unnest({_LANGS}) as lang), spaced as (select distinct num from props_ where property = 'instance_of' and value = {PEOPLE}),
lent as (select g.num, langs.lang from good g, langs where not exists (select 1 from lab where lab.num = g.num and lab.lang = langs.lang)),
every as (select num, lang, label as key, -1::bigint as pos from lab where lang in (select lang from langs) union all select a.num, a.lang, alias, pos from ali a join lab using (num, lang) where a.lang in (select lang from langs)
union all select num, lent.lang, label, -1 from lent join (select num, label from lab where lang = 'en') using (num) union all select num, lent.lang, alias, pos from lent join (select num, alias, pos from ali where lang = 'en') using (num)),
forms as (select lang, key, num, pos as ord from every e left join (select num, true as spaced from spaced) using (num) where key <> '' and not regexp_full_match(key, '\\p{{N}}+')
and (pos < 0 or spaced is null or instr(key, ' ') > 0 or {_UPPER.format('key')}) and (spaced is null or instr(key, ' ') > 0) and (length(key) >= 4 or ({_UPPER.format('key')} and length(key) >= 3))),
patch as (select trim(alias) as alias, {Q.idno('id')} as num, lang from labels_patch),
gone as (select distinct coalesce(nullif(lang, 'all'), l) as lang, key from (select lang, unnest({_variants('alias')}) as key from patch where num is null and alias <> ''), (select unnest({_LANGS}) as l)),
post as (select lang, key, list(num order by num, ord) as ids from forms f where not exists (select 1 from gone where gone.lang = f.lang and gone.key = f.key) group by all),
fix as (select lang, key, [min_by(num, (general, num))] as ids from (select coalesce(nullif(lang, 'all'), l) as lang, lang = 'all' as general, key, num from (select lang, num, unnest({_variants('alias')}) as key from patch where alias <> '' and num in (select num from good)), (select unnest({_LANGS}) as l)) where lang in (select lang from langs) group by lang, key),
lexicon as (select * from post p where not exists (select 1 from fix where fix.lang = p.lang and fix.key = p.key) union all select * from fix)"""
LEXICON_SQL = f"{Q.KB}, {_FORMS}"


def good_knowledge(spark, sf_dir) -> K.KnowledgeBase:
    """Entities with a valid English label and an English description."""
    kb = knowledge(spark, sf_dir)
    named = kb.labels.where((F.col("lang") == "en") & T.valid_label(F.col("label"))).select("num")
    return K.restricted(kb, K.usable(kb).join(named, "num", "left_semi"))


def patches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels_patch").select(F.trim("alias").alias("alias"), entity_number("id").alias("num"), "lang")


def lexicon_of(spark, sf_dir, kb: K.KnowledgeBase) -> DataFrame:
    """The whole lexicon: forms, less the removed ones (patches without an entity), with the patches."""
    edits = patches(spark, sf_dir)
    forms = L.removed(L.surface_forms(kb, LANGS, [PEOPLE]), edits.where("num is null").select("lang", F.col("alias").alias("label")), LANGS)
    return L.patched(L.posting_lists(forms), edits, kb, LANGS)


@query(f"with {LEXICON_SQL} select lang, key, num, ord from forms")
def lexicon_forms(spark, sf_dir):
    return L.surface_forms(good_knowledge(spark, sf_dir), LANGS, [PEOPLE])


@query(f"with {LEXICON_SQL} select lang, key, array_to_string(ids, ' ') as ids from lexicon")
def lexicon_patch_remove(spark, sf_dir):
    lexicon = lexicon_of(spark, sf_dir, good_knowledge(spark, sf_dir))
    return lexicon.select("lang", "key", F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@query(f"with {LEXICON_SQL} select lang, count(distinct key) as n_keys, count(distinct id) as n_entities from (select lang, key, unnest(ids) as id from lexicon) group by lang")
def accessible_entities(spark, sf_dir):
    lexicon = lexicon_of(spark, sf_dir, good_knowledge(spark, sf_dir))
    return lexicon.select("lang", "key", F.explode("ids").alias("id")).groupBy("lang").agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("id").alias("n_entities"))


@query(f"select trim(alias) as alias, unnest({_variants('trim(alias)')}) as variant from labels_patch where trim(alias) <> ''")
def case_variants(spark, sf_dir):
    return patches(spark, sf_dir).where("alias <> ''").select("alias", F.explode(T.case_variants(F.col("alias"))).alias("variant"))


@query(f"with {Q.KB} select label, min(num) as num from labels_ where lang = 'en' group by label")
def invert_kb(spark, sf_dir):
    return K.smallest_by_label(knowledge(spark, sf_dir), "en")


@query(f"with {Q.KB} select lang, count(*) as n_labels, count(distinct label) as n_distinct from labels_ group by lang")
def num_labels(spark, sf_dir):
    return knowledge(spark, sf_dir).labels.groupBy("lang").agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("label").alias("n_distinct"))


_COUNTS = "eng as (select num, label from labels_ where lang = 'en'), counts as (select property, value, coalesce(e.label, 'Q' || value) as label, n from (select property, value, count(*) as n from props_ where property in ('instance_of', 'facet_of', 'subclass_of') and num in (select num from eng) group by all) left join eng e on e.num = value)"


@query(f"with {Q.KB}, {_COUNTS} select * from counts")
def property_counts(spark, sf_dir):
    return K.property_counts(knowledge(spark, sf_dir))


_CURATED = f"curated as (select value, max(relevant) as relevant from (select {Q.idno('entity')} as value, (description is not null)::integer as relevant from entities_add) group by value)"


def _curated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "entities_add").select(entity_number("entity").alias("value"), F.col("description").isNotNull().cast("int").alias("relevant"))


@query(f"with {Q.KB}, {_COUNTS}, {_CURATED} select property, c.value, label, n, case when relevant > 0 then '1' else '' end as relevant from counts c left join curated using (value)")
def property_counts_curated_merge(spark, sf_dir):
    return K.merge_curated(K.property_counts(knowledge(spark, sf_dir)), _curated(spark, sf_dir))


@query(f"with {Q.KB}, {_COUNTS}, {_CURATED} select property, c.value from counts c join curated using (value) where relevant > 0")
def relevant_values(spark, sf_dir):
    return K.relevant_values(K.merge_curated(K.property_counts(knowledge(spark, sf_dir)), _curated(spark, sf_dir)))


@query(f"with {Q.KB}, {_COUNTS}, {_CURATED}, rel as (select property, c.value from counts c join curated using (value) where relevant > 0) select rec as num from recs where rec in (select num from props_ join rel using (property, value)) or rec in (select {Q.idno('entity')} from entities_add)")
def kb_property_gate(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    relevant = K.relevant_values(K.merge_curated(K.property_counts(kb), _curated(spark, sf_dir)))
    return K.gated(kb, relevant, _curated(spark, sf_dir).select(F.col("value").alias("num")))


@query(f"with {Q.KB}, wanted as (select 'country' as property, {Q.idno('entity')} as value from entities_add union select 'citizenship', {Q.idno('entity')} from entities_add) select rec as num from recs where rec in (select num from props_ join wanted using (property, value)) or rec in (select value from wanted)")
def kb_by_properties(spark, sf_dir):
    ids = table(spark, sf_dir, "entities_add").select(entity_number("entity").alias("value"))
    wanted = ids.select(F.explode(F.array(F.lit("country"), F.lit("citizenship"))).alias("property"), "value")
    return K.by_property_values(knowledge(spark, sf_dir), wanted.distinct(), include_values=True)


_TOP = f"top as (select num from (select {Q.idno('entity')} as num, max(qrank) as q from qrank where {Q.idno('entity')} is not null group by 1 order by q desc nulls last, num limit 500) union select {Q.idno('entity')} from entities_add)"


def _top(spark, sf_dir) -> DataFrame:
    return K.top_ranked(table(spark, sf_dir, "qrank"), 500, table(spark, sf_dir, "entities_add").select(entity_number("entity").alias("num")))


@query(f"with {Q.KB}, {_TOP} select rec as num from recs where rec in (select num from top)")
def qrank_semi_join(spark, sf_dir):
    return knowledge(spark, sf_dir).entities.join(_top(spark, sf_dir), "num", "left_semi")


@query(f"with {Q.KB} select rec as num from recs where rec not in (select {Q.idno('entity')} from entities_add where description is null)")
def entities_remove_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "entities_add").where("description is null").select(entity_number("entity").alias("num"))
    return knowledge(spark, sf_dir).entities.join(gone, "num", "left_anti")


@query(f"with {Q.KB} select num from labels_ where lang = 'en' and not {_NUMBER.format('label')} and num in (select num from descriptions_ where lang = 'en')")
def kb_usable(spark, sf_dir):
    return K.usable(knowledge(spark, sf_dir))


@query(f"with {Q.KB} select l.num, l.label, case when coalesce(description, '') = '' then l.label when instr(description, l.label) = 0 then l.label || ', ' || description else description end as described from labels_ l left join descriptions_ d on d.num = l.num and d.lang = l.lang where l.lang = 'en'")
def entity_description(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    both = kb.labels.where("lang = 'en'").join(kb.descriptions, ["num", "lang"], "left")
    return both.select("num", "label", T.description_of(F.col("label"), F.col("description")).alias("described"))


@query(f"with {Q.KB} select distinct 'Q' || num || chr(9) || 'Q' || value as line from props_ where num <> value")
def edges_export(spark, sf_dir):
    return K.edges(knowledge(spark, sf_dir)).select(F.concat(F.lit("Q"), "src", F.lit("\t"), F.lit("Q"), "dst").alias("line"))


@query(f"select src, count(*) as n, count(distinct dst) as n_distinct from (select {Q.idno('src')} as src, {Q.idno('dst')} as dst from edges) where src is not null and dst is not null and src <> dst group by src")
def edge_degrees(spark, sf_dir):
    e = table(spark, sf_dir, "edges").select(entity_number("src").alias("src"), entity_number("dst").alias("dst")).where("src <> dst")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).groupBy("src").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query(f"with {Q.PAGES} select page_no, array_to_string(list_transform(l, lambda x: 'Q' || x), ' ') as line from (select page_no, list_filter(list_transform(text_entities, lambda x: {Q.idno('x')}), lambda x: x is not null) as l from curp where text_entities is not null)")
def text_entities_export(spark, sf_dir):
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "l": entity_numbers("text_entities")})
    return now.where("l is not null").select("page_no", F.array_join(F.transform("l", lambda x: F.concat(F.lit("Q"), x)), " ").alias("line"))


@query(f"""with {Q.KB}, human as (select distinct num from props_ where property = 'instance_of' and value = {PEOPLE}), lack as (select rec as num from recs where rec not in (select num from labels_ where lang = 'tr') and rec not in (select num from human)),
texts as (select num, label as text from labels_ where lang = 'en' union all select num, alias from aliases_ where lang = 'en') select distinct text from texts where num in (select num from lack) and length(text) >= 4 and instr(text, ' ') > 0 and not {_UPPER.format('text')}""")
def labels_to_translate(spark, sf_dir):
    return K.to_translate(knowledge(spark, sf_dir), "tr", PEOPLE)


_CLEAN = "array_to_string(list_transform(string_split(replace({0}, ',', ' '), ' '), lambda w: split_part(w, '''', 1)), ' ')"


@query(f"select a.p_partkey as line_no, a.p_name as label, {_CLEAN.format('b.title')} as translation from part a join documents b on b.doc_id = a.p_partkey where b.title is not null")
def merge_translations(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("label"))
    lines = table(spark, sf_dir, "documents").where("title is not null").select(F.col("doc_id").alias("n"), T.translation_clean(F.col("title")).alias("translation"))
    return labels.join(lines, F.col("line_no") == F.col("n")).select("line_no", "label", "translation")


_TITLES = f"""t as (select rec as num, translate(enwiki, '_', ' ') as title from recs where enwiki is not null and enwiki <> ''),
titles as (select title, min_by(num, (prio, num)) as num from (select title, num, 0 as prio from t union all select {_title('title')}, num, 1 from t union all select lower(title), num, 2 from t union all select label, num, 3 from labels_ where lang = 'en') group by title)"""


@query(f"with {Q.KB}, {_TITLES} select title, num from titles")
def page_title_map(spark, sf_dir):
    return K.page_titles(knowledge(spark, sf_dir))


_EXCLUDED = "(" + " and ".join(f"instr(h, '{x}') = 0" for x in P.EXCLUDED) + ")"
_ANCHORS = f"""links as (select page_no, unnest(l) as h from (select page_no, list_filter(regexp_extract_all(page, '<a [^<>]*href="/wiki/([^"]+)"', 1), lambda h: {_EXCLUDED}) as l from wiki_page)),
named as (select page_no, split_part(translate(split_part(h, '#', 1), '_', ' '), ' (', 1) as title from links)"""


@query(f"with {Q.KB}, {_TITLES}, {_ANCHORS} select page_no, num, count(*) as n from named join titles using (title) group by all")
def page_anchors(spark, sf_dir):
    found = P.anchors(table(spark, sf_dir, "wiki_page"), "page_no", "page", K.page_titles(knowledge(spark, sf_dir)))
    return found.groupBy("page_no", "num").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "replace(replace(replace(replace(replace(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '\\[\\d+(, ?\\d+)*\\]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"select page_no, md5(coalesce(array_to_string(list_transform(regexp_extract_all(regexp_replace(page, '<span[^>]*>[^<]*</span>', '', 'g'), '<p>(.*?)</p>', 1), lambda p: {_PLAIN}), chr(10)), '')) as digest from wiki_page where page is not null")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "wiki_page").where("page is not null").select("page_no", F.md5(F.encode(P.paragraphs(F.col("page")), "UTF-8")).alias("digest"))


@query(f"with {Q.PAGES}, {Q.TOKENS}, c as (select doc as page_no, tok as num, count(*) as n from toks group by all), own as (select page_no, num from curp), most as (select page_no, max(n) as most from c group by 1) select page_no, num, n from c where not exists (select 1 from own where own.page_no = c.page_no and own.num = c.num) union all select page_no, num, coalesce(most, 0) + 1 from own left join most using (page_no)")
def page_entities_boost(spark, sf_dir):
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "l": entity_numbers("text_entities")})
    counts = now.select("page_no", F.explode("l").alias("num")).groupBy("page_no", "num").agg(F.count(F.lit(1)).alias("n"))
    return P.boosted(counts, now.select("page_no", F.col("key").alias("num")))


@query("select field, status, count(*) as n from (select field, case when t is null or t = '' then 'missing' when not json_valid(t) then 'damaged' when json_type(t::json) = 'OBJECT' then 'object' else 'other' end as status from (select 'labels' as field, labels as t from wikidata_summary union all select 'aliases', aliases from wikidata_summary union all select 'properties', properties from wikidata_summary)) group by all")
def json_bad_lines(spark, sf_dir):
    """How the JSON fields parse. `try_parse_json` takes what stands behind a value for nothing, so a text must also end with its value's mark."""
    t = F.trim("t")
    parsed = F.try_parse_json("t")
    kind = F.schema_of_variant(parsed)
    whole = F.when(t.startswith("{"), t.endswith("}")).when(t.startswith("["), t.endswith("]")).otherwise(F.lit(True))
    status = F.when(F.coalesce("t", F.lit("")) == "", "missing").when(parsed.isNull() | ~whole, "damaged").when(kind.startswith("OBJECT"), "object").otherwise("other")
    rows = table(spark, sf_dir, "wikidata_summary").select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("labels", "aliases", "properties")])).alias("x")).select("x.field", "x.t")
    return rows.select("field", status.alias("status")).groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {Q.KB} select num, property, pos, value from props_")
def claims_flatten(spark, sf_dir):
    return knowledge(spark, sf_dir).properties


@query(f"with {Q.KB}, d as (select doc_id, {Q.idno('entity_id')} as num from documents) select doc_id, d.num, coalesce(label, '<NO TRANSLATION>') as label from d left join (select num, label from labels_ where lang = 'ru') using (num)")
def translate_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", entity_number("entity_id").alias("num"))
    return K.translated(rows, "num", knowledge(spark, sf_dir), "ru")
