"""Queries over pages as texts about their entities, and over vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import entity_number, entity_numbers
from ..operators import bags as B
from ..operators import disambiguate as D
from ..operators import kb as K
from ..operators import lexicon as L
from ..operators import matching as M
from ..operators import pages as P
from ..operators.states import latest_state
from ..session import materialise
from ..sources import files
from . import sql as Q
from .catalog import query, table
from .kb_queries import LEXICON_SQL, _title, good_knowledge, knowledge, patches
from .topic_queries import _DOT, DIMS, THRESHOLD, _entity_vectors, _freqs, _lexicon, _mean, _tokens

_TEXT_WORDS = "array_to_string((list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> ''))[1:300], ' ')"


@query(
    f"with {Q.KB}, {Q.PAGES}, paged as (select num, {_TEXT_WORDS} as text from curp where trim(text, ' ') <> '') select num, md5(text) as digest from paged union all "
    "select num, md5(case when coalesce(description, '') = '' then label when instr(description, label) = 0 then label || ', ' || description else description end) from (select num, label from labels_ where lang = 'en') l left join (select num, description from descriptions_ where lang = 'en') d using (num) where num not in (select num from paged)"
)
def embedding_texts(spark, sf_dir):
    """What an encoder is fed with for each entity."""
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"text": F.col("text")})
    return K.embedding_texts(knowledge(spark, sf_dir), now.withColumnRenamed("key", "num")).select("num", F.md5(F.encode("text", "UTF-8")).alias("digest"))


_RUNS = "'[\\pL\\pN]+|[^\\pL\\pN]'"
_PAGE_ENTITIES = f"""{LEXICON_SQL}, {Q.ENTITY_VECTORS}, k as (select key, ids, parts, parts[1] as first, len(parts) as n from (select key, ids, regexp_extract_all(key, {_RUNS}) as parts from lexicon where lang = 'en')),
docs as (select page_no as doc_id, num as own, page, regexp_extract_all(translate(text, chr(10), ' '), {_RUNS}) as l from curp), seg as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i, len(l) as total from docs),
pos as (select *, sum(length(s)) over (partition by doc_id order by i rows unbounded preceding) - length(s) as start from seg),
heads as (select doc_id, i, start, total, s as head, false as plural from pos union all select doc_id, i, start, total, s[: length(s) - 1], true from pos where length(s) > 1 and s[length(s)] in ('s', 'S') and regexp_full_match(s, '[\\pL\\pN]+')),
cand as (select h.doc_id, h.start, k.key, k.parts, k.n, h.i, h.total from heads h join k on k.first = h.head where not (h.plural and (k.n > 1 or h.i = h.total)) and h.i + k.n - 1 <= h.total),
hit as (select c.doc_id, c.start, c.start + length(c.key) as stop, c.key from cand c join docs d using (doc_id) where c.n = 1 or d.l[c.i : c.i + c.n - 1] = c.parts
or (d.l[c.i : c.i + c.n - 2] = c.parts[1 : c.n - 1] and c.i + c.n - 1 < c.total and regexp_full_match(c.parts[c.n], '[\\pL\\pN]+') and d.l[c.i + c.n - 1] in (c.parts[c.n] || 's', c.parts[c.n] || 'S'))),
kept as (select * from (select doc_id, start, stop, key, max(stop) over (partition by doc_id order by start, stop desc, key rows between unbounded preceding and 1 preceding) as reach from (select distinct * from hit)) where reach is null or stop > reach),
near as (select *, lead(start) over w as ns, lead(stop - start) over w as nz, lag(stop) over w as ps, lag(stop - start) over w as pz from kept window w as (partition by doc_id order by start)),
ment as (select doc_id, start, stop, key from near where not coalesce(stop >= ns and stop - start < nz, false) and not coalesce(ps >= start and pz >= stop - start, false)),
cands as (select m.doc_id, m.start, unnest(k.ids) as num, generate_subscripts(k.ids, 1) - 1 as ord from ment m join k using (key)), dvec as {_mean('(select doc_id, vec from cands join vecs using (num))', 'doc_id')},
t as (select rec as num, translate(enwiki, '_', ' ') as title from recs where enwiki is not null and enwiki <> ''), titles as (select title, min_by(num, (prio, num)) as num from (select title, num, 0 as prio from t union all select {_title('title')}, num, 1 from t union all select lower(title), num, 2 from t union all select label, num, 3 from labels_ where lang = 'en') group by title),
links as (select doc_id, unnest(list_filter(regexp_extract_all(page, '<a [^<>]*href="/wiki/([^"]+)"', 1), lambda h: {" and ".join(f"instr(h, '{x}') = 0" for x in P.EXCLUDED)})) as h from docs),
linked as (select doc_id, num from links join titles on title = split_part(translate(split_part(h, '#', 1), '_', ' '), ' (', 1)),
sc as (select p.kind, p.doc_id, p.num, {_DOT.format('v.vec', 'd.vec')} / (sqrt({_DOT.format('v.vec', 'v.vec')}) * sqrt({_DOT.format('d.vec', 'd.vec')})) as score from (select distinct 'l' as kind, doc_id, num from linked union select distinct 'm', doc_id, num from cands) p join vecs v using (num) join dvec d using (doc_id)),
good as materialized (select kind, doc_id, num, score from (select *, max(score) over (partition by kind, doc_id) as best from sc) where score >= {THRESHOLD} * best and score <> 0),
found as (select doc_id, num from linked where exists (select 1 from good g where g.kind = 'l' and g.doc_id = linked.doc_id and g.num = linked.num)
union all select doc_id, num from (select c.doc_id, c.start, c.num, row_number() over (partition by c.doc_id, c.start order by round(score, 9) desc, ord, c.num) as r from cands c join good g on g.kind = 'm' and g.doc_id = c.doc_id and g.num = c.num) where r = 1
union all select doc_id, own from docs), cnt as (select doc_id, num, count(*) as n from found group by all), most as (select doc_id, max(n) as most from cnt group by 1)
select doc_id as page_no, num, case when num = own then most + 1 else n end as n from cnt join most using (doc_id) join docs using (doc_id)"""
_PAGE_ENTITIES = _PAGE_ENTITIES.replace("good as (select num from labels_", "good_ as (select num from labels_", 1).replace("from good g, langs", "from good_ g, langs").replace("in (select num from good)", "in (select num from good_)")


@query(f"with {_PAGE_ENTITIES}")
def page_text_entities(spark, sf_dir):
    """The entities of each current page: itself, what it links and what its text mentions, scored against the page; itself most often."""
    pages = materialise(latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "text": F.col("text"), "page": F.col("page")}).withColumn("lang", F.lit("en")))
    lexicon = _lexicon(spark, sf_dir)
    vectors = materialise(_entity_vectors(spark, sf_dir))
    found = M.mentions(pages, "page_no", "text", "lang", lexicon)
    cands = materialise(D.candidates(found, pages.select(F.col("page_no").alias("doc_id"), "lang"), lexicon))
    docs = materialise(D.mean_of_candidates(cands, vectors, DIMS))
    picked = D.chosen(cands, D.scored(cands, docs, vectors, THRESHOLD)).select("doc_id", "num")
    linked = materialise(P.anchors(pages, "page_no", "page", K.page_titles(knowledge(spark, sf_dir))).select(F.col("page_no").alias("doc_id"), "num"))
    good = D.scored(linked, docs, vectors, THRESHOLD).select("doc_id", "num")
    own = pages.select("page_no", F.col("key").alias("num"))
    every = picked.unionAll(linked.join(good, ["doc_id", "num"], "left_semi")).unionAll(own.select("page_no", "num"))
    counts = materialise(every.groupBy(F.col("doc_id").alias("page_no"), "num").agg(F.count(F.lit(1)).alias("n")))
    return P.boosted(counts, own)


@query(f"with {Q.PAGES}, {Q.TOKENS} select count(distinct tok) as n_words, count(*) as n_tokens, count(distinct doc) as n_docs from toks")
def vocabulary_size(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.agg(F.count_distinct("tok").alias("n_words"), F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("doc").alias("n_docs"))


@query(f"with {Q.PAGES}, {Q.TOKENS}, c as (select doc, tok, count(*) as n from toks group by all) select round(count(*)::double / ((select count(distinct doc) from c) * (select count(distinct tok) from c)), 9) as density from c")
def matrix_density(spark, sf_dir):
    counts = _freqs(_tokens(spark, sf_dir)).select(F.col("doc_id").alias("owner"), F.col("num").alias("key"), F.col("n").alias("value"))
    return B.density(counts).select(F.round("density", 9).alias("density"))


@query(f"with {Q.PAGES}, {Q.TOKENS} select doc, pos, tok from toks where tok in (select {Q.idno('entity')} from entities_add)")
def vocabulary_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "entities_add").select(entity_number("entity").alias("num"))
    return B.in_vocabulary(_tokens(spark, sf_dir), "tok", wanted).select("doc", F.col("pos").cast("bigint").alias("pos"), "tok")


@query(f"with {LEXICON_SQL}, k as (select distinct key from lexicon where lang = 'en') select key, row_number() over (order by md5(key), key) - 1 as key_id from k")
def lexicon_dictionary(spark, sf_dir):
    from .kb_queries import lexicon_of

    return L.dictionary(lexicon_of(spark, sf_dir, good_knowledge(spark, sf_dir)), "en")


@query(
    f"with {Q.KB}, pairs as (select 'fr' as lang, a.label, b.label as translation from labels_ a join labels_ b using (num) where a.lang = 'en' and b.lang = 'fr'), rm as (select lang, trim(alias) as label from labels_patch where {Q.idno('id')} is not null) "
    "select distinct lang, label, translation from pairs p where not exists (select 1 from rm where rm.lang in ('en', 'all') and rm.label = p.label) and not exists (select 1 from rm where rm.lang in (p.lang, 'all') and rm.label = p.translation)"
)
def translation_pairs(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    fr = kb.labels.where("lang = 'fr'").select("num", F.col("label").alias("translation"), "lang")
    pairs = kb.labels.where("lang = 'en'").select("num", "label").join(fr, "num")
    gone = patches(spark, sf_dir).where("num is not null").select("lang", F.col("alias").alias("label"))
    return K.usable_translations(pairs, gone).distinct()


@query("select '{\"p_brand\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}' as json from part")
def namespace_json(spark, sf_dir):
    return files.row_json(table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_brand"))


@query(f"with {Q.PAGES}, {Q.TOKENS} select page_no, md5(text) as digest, n from curp join (select doc, count(*) as n from toks group by 1) t on t.doc = page_no where text <> ''")
def page_texts_with_tokens(spark, sf_dir):
    """Pages that have both a text and tokens, with both: what a model of texts and entities is trained on."""
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "text": F.col("text"), "n": F.size(entity_numbers("text_entities"))})
    return now.where("text <> '' and n > 0").select("page_no", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.col("n").cast("bigint").alias("n"))
