"""Queries from texts to topics: mentions, disambiguation, vectors, topics, coherence, reports."""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import entity_number, entity_numbers
from ..operators import coherence as H
from ..operators import disambiguate as D
from ..operators import gibbs as G
from ..operators import kb as K
from ..operators import matching as M
from ..operators import reports as R
from ..operators import topics as T
from ..operators import vectors as V
from ..operators.states import latest_state
from ..session import materialise
from . import sql as Q
from .catalog import query, table
from .kb_queries import LANGS, LEXICON_SQL, good_knowledge, knowledge, lexicon_of

DIMS, TOPICS, ROUNDS, WORDS, THRESHOLD = 64, 8, 3, 50, 0.5
REFERENCE_TOPICS, REFERENCE_ROUNDS, REFERENCE_WORDS, REFERENCE_SWEEPS = 100, 300, 500, 1000  # what the reference trains with; sweeps are LDA's


@dataclass(frozen=True)
class Training:
    """How the topics are trained that a query stands on."""

    topics: int
    rounds: int
    words: int


SMALL = Training(TOPICS, ROUNDS, WORDS)  # what unrolled SQL can follow
_TRAINING: ContextVar[Training] = ContextVar("training", default=SMALL)

# --- mentions

_RUNS = "'[\\pL\\pN]+|[^\\pL\\pN]'"
_CODE = "regexp_replace(lower(trim(coalesce(lang, ''))), '[-_].*$', '')"
_MENTIONS = f"""{LEXICON_SQL}, lkeys as (select lang, key, regexp_extract_all(key, {_RUNS}) as parts from (select distinct lang, key from lexicon)), k as (select lang, key, parts, parts[1] as first, len(parts) as n from lkeys),
docs as (select doc_id, case when {_CODE} in (select lang from lexicon) then {_CODE} else 'en' end as lang, regexp_extract_all(translate(text, chr(10), ' '), {_RUNS}) as l from documents where text <> ''),
seg as (select doc_id, lang, unnest(l) as s, generate_subscripts(l, 1) as i, len(l) as total from docs), pos as (select *, sum(length(s)) over (partition by doc_id order by i rows unbounded preceding) - length(s) as start from seg),
heads as (select doc_id, lang, i, start, total, s as head, false as plural from pos union all select doc_id, lang, i, start, total, s[: length(s) - 1], true from pos where length(s) > 1 and s[length(s)] in ('s', 'S') and regexp_full_match(s, '[\\pL\\pN]+')),
cand as (select h.doc_id, h.lang, h.start, k.key, k.parts, k.n, h.i, h.total, h.plural from heads h join k on k.lang = h.lang and k.first = h.head where not (h.plural and (k.n > 1 or h.i = h.total)) and h.i + k.n - 1 <= h.total),
hit as (select c.doc_id, c.start, c.start + length(c.key) as stop, c.key from cand c join docs d using (doc_id) where c.n = 1 or d.l[c.i : c.i + c.n - 1] = c.parts
or (d.l[c.i : c.i + c.n - 2] = c.parts[1 : c.n - 1] and c.i + c.n - 1 < c.total and regexp_full_match(c.parts[c.n], '[\\pL\\pN]+') and d.l[c.i + c.n - 1] in (c.parts[c.n] || 's', c.parts[c.n] || 'S'))),
kept as (select * from (select doc_id, start, stop, key, max(stop) over (partition by doc_id order by start, stop desc, key rows between unbounded preceding and 1 preceding) as reach from (select distinct * from hit)) where reach is null or stop > reach),
near as (select *, lead(start) over w as ns, lead(stop - start) over w as nz, lag(stop) over w as ps, lag(stop - start) over w as pz from kept window w as (partition by doc_id order by start)),
ment as (select doc_id, start, stop, key from near where not coalesce(stop >= ns and stop - start < nz, false) and not coalesce(ps >= start and pz >= stop - start, false))"""


def _lexicon(spark, sf_dir) -> DataFrame:
    return materialise(lexicon_of(spark, sf_dir, good_knowledge(spark, sf_dir)))


def _mentions(spark, sf_dir, lexicon: DataFrame, overlaps: bool = False) -> DataFrame:
    return M.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", lexicon, overlaps=overlaps)


@query(f"with {_MENTIONS} select doc_id, start::integer as start, stop::integer as stop, key from ment")
def entity_mentions(spark, sf_dir):
    """Every mention of a lexicon key in the documents."""
    return _mentions(spark, sf_dir, _lexicon(spark, sf_dir))


@query(f"with {_MENTIONS} select doc_id, start::integer as start, stop::integer as stop, key from ment")
def interval_overlap(spark, sf_dir):
    """The same from the table of all matches, by window functions."""
    return M.resolve_overlaps(_mentions(spark, sf_dir, _lexicon(spark, sf_dir), overlaps=True))


@query(f"""with {_MENTIONS}, t as (select doc_id, translate(coalesce(text, ''), chr(10), ' ') as t from documents), m as (select doc_id, start, stop, key, coalesce(lag(stop) over (partition by doc_id order by start), 0) as last from ment),
b as (select doc_id, string_agg(t[last + 1 : start] || ' __match__' || replace(key, ' ', '_') || ' ', '' order by start) as head, max(stop) as stop from m join t using (doc_id) group by doc_id)
select doc_id, md5(case when b.stop is null then t else head || t[b.stop + 1 :] end) as digest from t left join b using (doc_id)""")
def mention_mask(spark, sf_dir):
    found = _mentions(spark, sf_dir, _lexicon(spark, sf_dir))
    return M.masked(table(spark, sf_dir, "documents"), "doc_id", "text", found).select("doc_id", F.md5(F.encode("masked", "UTF-8")).alias("digest"))


# --- disambiguation


def _entity_vectors(spark, sf_dir) -> DataFrame:
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"embedding": F.col("embedding")})
    return V.usable(now, "key", "embedding", DIMS)


def _mean(source: str, by: str, weight: str = "1.0") -> str:
    return f"(select {by}, list(m order by p) as vec from (select {by}, p, sum(x * w) / sum(w) as m from (select {by}, unnest(vec) as x, generate_subscripts(vec, 1) as p, {weight} as w from {source}) group by all) group by {by})"


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_COS = f"({_DOT.format('v.vec', 'd.vec')} / (sqrt({_DOT.format('v.vec', 'v.vec')}) * sqrt({_DOT.format('d.vec', 'd.vec')})))"


def _scores(pairs: str) -> str:
    return f"""(select doc_id, num, score from (select *, max(score) over (partition by doc_id) as best from (select p.doc_id, p.num, {_COS} as score from (select distinct doc_id, num from {pairs}) p join vecs v using (num) join dvec d using (doc_id))) where score >= {THRESHOLD} * best and score <> 0)"""


_CHOSEN = f"""{_MENTIONS}, {Q.ENTITY_VECTORS}, cands as (select m.doc_id, m.start, unnest(x.ids) as num, generate_subscripts(x.ids, 1) - 1 as ord from ment m join docs d using (doc_id) join lexicon x on x.lang = d.lang and x.key = m.key),
dvec as {_mean('(select doc_id, vec from cands join vecs using (num))', 'doc_id')}, scores as {_scores('cands')},
chosen as (select doc_id, start, num from (select *, row_number() over (partition by doc_id, start order by round(score, 9) desc, ord, num) as r from cands join scores using (doc_id, num)) where r = 1)"""


def _resolution(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    code = F.regexp_replace(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "[-_].*$", "")
    lang = table(spark, sf_dir, "documents").select("doc_id", F.when(code.isin(*LANGS), code).otherwise("en").alias("lang"))
    cands = materialise(D.candidates(_mentions(spark, sf_dir, lexicon), lang, lexicon))
    vectors = materialise(_entity_vectors(spark, sf_dir))
    docs = materialise(D.mean_of_candidates(cands, vectors, DIMS))
    return cands, vectors, docs, D.scored(cands, docs, vectors, THRESHOLD)


@query(f"with {_CHOSEN} select doc_id, num, round(score, 6) as score from scores")
def entity_scores(spark, sf_dir):
    return _resolution(spark, sf_dir)[3].select("doc_id", "num", F.round("score", 6).alias("score"))


@query(f"with {_CHOSEN} select doc_id, num, count(*) as n from chosen group by all")
def disambiguate(spark, sf_dir):
    cands, _, _, scores = _resolution(spark, sf_dir)
    return D.bags(D.chosen(cands, scores))


@query(f"with {_CHOSEN} select doc_id, num, count(*) as n from chosen where doc_id in (select doc_id from chosen group by 1 having count(*) >= 5) group by all")
def min_entity_docs(spark, sf_dir):
    cands, _, _, scores = _resolution(spark, sf_dir)
    return D.bags(D.chosen(cands, scores), 5)


@query(f"with {_CHOSEN}, more as (select c.doc_id, v.value as num from chosen c join (select distinct num, value from props_) v using (num)), good_more as {_scores('more')} select doc_id, num, count(*) as n from (select doc_id, num from chosen union all select doc_id, num from more where exists (select 1 from good_more g where g.doc_id = more.doc_id and g.num = more.num)) group by all")
def disambiguate_extend(spark, sf_dir):
    cands, vectors, docs, scores = _resolution(spark, sf_dir)
    return D.bags(D.extended(D.chosen(cands, scores), knowledge(spark, sf_dir).properties, docs, vectors, THRESHOLD))


# --- vectors and topics; documents are the current pages with their listed entities


@query(f"with {Q.ENTITY_VECTORS}, g as (select vec_id as num, list_transform(embedding, lambda x: x::double) as v from embeddings), two as (select vecs.num, vec, v from vecs join g on g.num = vecs.num % (select count(*) from embeddings)) select num, list_transform(list_concat(list_transform(vec, lambda x: x * sqrt(2.0 / 3)), list_transform(v, lambda x: x * sqrt(1.0 / 3))), lambda x: round(x, 6)) as vec from two")
def bimodal_embedding(spark, sf_dir):
    first = _entity_vectors(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    g = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    second = first.select("num", (F.col("num") % n).alias("vec_id")).join(g, "vec_id").select("num", "vec")
    return V.bimodal(first, second, 0.5).select("num", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(f"with {Q.RECORDS}, {Q.ENTITY_VECTORS} select rec as num from recs where rec not in (select num from vecs)")
def embedding_missing_report(spark, sf_dir):
    return V.missing(knowledge(spark, sf_dir).entities, _entity_vectors(spark, sf_dir))


@query(f"with {Q.ENTITY_VECTORS} select num, 'Q' || num || ' ' || array_to_string(list_transform(vec, lambda x: printf('%.8f', round(x, 8) + 0.0)), ' ') as line from vecs")
def embedding_export(spark, sf_dir):
    from ..sources.files import embedding_line

    return _entity_vectors(spark, sf_dir).select("num", embedding_line(F.concat(F.lit("Q"), "num"), F.col("vec")).alias("line"))


_TOK = f"{Q.ENTITY_VECTORS}, {Q.TOKENS}, freq as (select doc, tok as num, count(*)::double as n from toks group by all)"
_DVEC = f"{_TOK}, dv as {_mean('(select doc, n, vec from freq join vecs using (num))', 'doc', 'n')}"


def _tokens(spark, sf_dir) -> DataFrame:
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"page_no": F.col("page_no"), "l": entity_numbers("text_entities")})
    return now.select(F.col("page_no").alias("doc"), F.posexplode("l").alias("pos", "tok")).select("doc", (F.col("pos") + 1).alias("pos"), "tok")


def _freqs(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(F.col("doc").alias("doc_id"), F.col("tok").alias("num")).agg(F.count(F.lit(1)).alias("n"))


def _doc_vectors(freqs: DataFrame, vectors: DataFrame) -> DataFrame:
    return V.weighted_mean(freqs.join(vectors, "num").select("doc_id", "vec", "n"), "doc_id", "vec", DIMS, "n")


@query(f"with {_TOK} select doc as doc_id, num, n::bigint as n, round(n / sum(n) over (partition by doc), 6) as freq from freq")
def bag_of_entities(spark, sf_dir):
    f = _freqs(_tokens(spark, sf_dir))
    total = f.groupBy("doc_id").agg(F.sum("n").alias("t"))
    return f.join(total, "doc_id").select("doc_id", "num", "n", F.round(F.col("n") / F.col("t"), 6).alias("freq"))


@query(f"with {_DVEC} select doc as doc_id, list_transform(vec, lambda x: round(x, 6)) as vec from dv")
def doc_vectors(spark, sf_dir):
    return _doc_vectors(_freqs(_tokens(spark, sf_dir)), _entity_vectors(spark, sf_dir)).select("doc_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _lloyd_sql() -> str:
    out = [f"c0 as materialized (select (row_number() over (order by num) - 1)::integer as topic, vec from (select * from vecs order by num limit {TOPICS}))"]
    for i in range(ROUNDS):
        out.append(f"l{i} as materialized (select num, vec, topic from (select v.num, v.vec, c.topic, row_number() over (partition by v.num order by {_D2.format('v.vec', 'c.vec')}, c.topic) as r from vecs v, c{i} c) where r = 1)")
        out.append(f"c{i + 1} as materialized (select topic, coalesce(m.vec, c.vec) as vec from c{i} c left join {_mean(f'l{i}', 'topic')} m using (topic))")
    return ", ".join(out)


_TRAIN = _lloyd_sql()
_C = f"c{ROUNDS}"
_WORDSQL = f"w0 as (select v.num, c.topic, {_D2.format('v.vec', 'c.vec')} as d2 from vecs v, {_C} c), w1 as (select *, row_number() over (partition by topic order by d2, num)::integer as place from w0), tw as materialized (select topic, place, num, (1 / (d2 + 1e-6)) / sum(1 / (d2 + 1e-6)) over (partition by topic) as score from w1 where place <= {WORDS})"
_PROB = f"dd as (select dv.doc as doc_id, c.topic, {_D2.format('dv.vec', 'c.vec')} as d2 from dv, {_C} c), dp as materialized (select *, row_number() over (partition by doc_id order by d2, topic)::integer as place, case when min(d2) over (partition by doc_id) = 0 then (d2 = 0)::integer::double else 1 / (d2 * d2) end as w from dd), dt as materialized (select doc_id, topic, d2, w / sum(w) over (partition by doc_id) as prob, place from dp)"


def _model(spark, sf_dir):
    vectors = materialise(_entity_vectors(spark, sf_dir))
    how = _TRAINING.get()
    return vectors, T.lloyd(vectors, T.start_vectors(vectors, how.topics), how.rounds)


@query(f"with {Q.ENTITY_VECTORS}, {_TRAIN} select topic, i::integer as dim, round(vec[i], 6) as value from {_C}, (select unnest(range(1, 65)) as i)")
def kmeans_lloyd(spark, sf_dir):
    _, c = _model(spark, sf_dir)
    rows = [(t, i + 1, float(c[t][i])) for t in range(len(c)) for i in range(DIMS)]
    return spark.createDataFrame(rows, "topic int, dim int, value double").withColumn("value", F.round("value", 6))


def _full_model(spark, sf_dir):
    vectors = materialise(_entity_vectors(spark, sf_dir))
    return vectors, T.lloyd(vectors, T.start_vectors(vectors, REFERENCE_TOPICS), REFERENCE_ROUNDS)


@query()
def kmeans_lloyd_full(spark, sf_dir):
    """Centroids of the reference's number of topics, after Lloyd rounds until nothing moves or the reference's number of rounds is done; without SQL."""
    c = _full_model(spark, sf_dir)[1]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "topic int, vec array<double>")


@query()
def topic_top_entities_full(spark, sf_dir):
    """The reference's number of words of each of those topics; without SQL."""
    vectors, c = _full_model(spark, sf_dir)
    return T.topic_words(vectors, c, REFERENCE_WORDS).select("topic", "place", "num", F.round("score", 6).alias("score"))


@query()
def kmeans_ml(spark, sf_dir):
    """The library's k-means with its own start, and the mean squared distance that it and the fixed start end with."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors, c = _model(spark, sf_dir)
    if len(c) < TOPICS:
        return spark.createDataFrame([], "kind string, mean_d2 double")
    fitted = KMeans(k=TOPICS, seed=1, maxIter=20).fit(vectors.select(array_to_vector("vec").alias("features")))
    own = T.nearest(vectors, "num", c).agg(F.avg("d2").alias("d2")).first().d2
    return spark.createDataFrame([("library", fitted.summary.trainingCost / max(vectors.count(), 1)), ("fixed start", own)], "kind string, mean_d2 double")


@query(f"with {Q.ENTITY_VECTORS}, {_TRAIN}, {_WORDSQL} select topic, place, num, round(score, 6) as score from tw")
def topic_top_entities(spark, sf_dir):
    vectors, c = _model(spark, sf_dir)
    return T.topic_words(vectors, c, WORDS).select("topic", "place", "num", F.round("score", 6).alias("score"))


def _doc_topics(spark, sf_dir, n=None):
    vectors, c = _model(spark, sf_dir)
    freqs = materialise(_freqs(_tokens(spark, sf_dir)))
    return vectors, c, freqs, T.document_topics(_doc_vectors(freqs, vectors), c, n=n)


@query(f"with {_DVEC}, {_TRAIN}, {_PROB} select doc_id, topic, round(d2, 6) as d2, round(prob, 6) as prob, place from dt")
def doc_topic_probs(spark, sf_dir):
    return _doc_topics(spark, sf_dir)[3].select("doc_id", "topic", F.round("d2", 6).alias("d2"), F.round("prob", 6).alias("prob"), "place")


@query(f"with {_DVEC}, {_TRAIN}, {_PROB} select page_no as doc_id, coalesce(topic, -1)::integer as topic from curp left join (select doc_id, topic from dt where place = 1) t on t.doc_id = page_no")
def doc_top_topic(spark, sf_dir):
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"doc_id": F.col("page_no")})
    return T.best_topic(now, _doc_topics(spark, sf_dir, 1)[3])


@query(f"with {_DVEC}, {_TRAIN}, {_PROB}, {_WORDSQL}, tt as (select topic, array_to_string(list('Q' || num order by place) filter (place <= 5), ' ') as words from tw group by topic) select doc_id, topic, round(prob, 6) as prob, place, words from dt join tt using (topic) where place <= 2")
def top_topics_words(spark, sf_dir):
    vectors, c, _, docs = _doc_topics(spark, sf_dir, 2)
    words = T.topic_words(vectors, c, 5).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "num"))), lambda x: F.concat(F.lit("Q"), x["num"])), " ").alias("words"))
    return T.top_topics(docs, 2).join(F.broadcast(words), "topic").select("doc_id", "topic", F.round("prob", 6).alias("prob"), "place", "words")


def _refresh_sql(n: int) -> str:
    return f"fr as (select doc as doc_id, num, n / sum(n) over (partition by doc) as f from freq), g as (select topic, num, sum(v) as v from (select topic, num, f * prob as v from fr join dt using (doc_id) where place <= {n} union all select topic, num, score * 1e-12 from tw) group by all), top as (select *, row_number() over (partition by topic order by round(v, 12) desc, num)::integer as place from g) select topic, place, num, round(v / sum(v) over (partition by topic), 6) as score from top where place <= 100"


def _refreshed(spark, sf_dir, n):
    vectors, c, freqs, docs = _doc_topics(spark, sf_dir, n)
    total = freqs.groupBy("doc_id").agg(F.sum("n").alias("t"))
    freq = freqs.join(total, "doc_id").select("doc_id", "num", (F.col("n") / F.col("t")).alias("freq"))
    return T.refreshed_words(freq, docs, T.topic_words(vectors, c, _TRAINING.get().words), n, 100)


@query(f"with {_DVEC}, {_TRAIN}, {_PROB}, {_WORDSQL}, {_refresh_sql(1)}")
def topic_word_update_hard(spark, sf_dir):
    return _refreshed(spark, sf_dir, 1).select("topic", "place", "num", F.round("score", 6).alias("score"))


@query(f"with {_DVEC}, {_TRAIN}, {_PROB}, {_WORDSQL}, {_refresh_sql(3)}")
def topic_word_update_soft(spark, sf_dir):
    return _refreshed(spark, sf_dir, 3).select("topic", "place", "num", F.round("score", 6).alias("score"))


# --- quality


def _words(spark, sf_dir):
    vectors, c = _model(spark, sf_dir)
    return materialise(T.topic_words(vectors, c, _TRAINING.get().words))


@query(f"with {Q.ENTITY_VECTORS}, {_TRAIN}, {_WORDSQL} select count(distinct num)::double / count(*) as diversity from tw where place <= 25")
def topic_diversity(spark, sf_dir):
    return H.diversity(_words(spark, sf_dir))


_PAIR = "wp as (select a.topic, a.num as w1, b.num as w2, least(a.num, b.num) as lo, greatest(a.num, b.num) as hi from tw a join tw b on a.topic = b.topic and a.place < b.place where a.place <= 10 and b.place <= 10)"
_DOCP = "du as (select distinct doc, tok from toks where tok in (select num from tw where place <= 10)), dn as (select x.tok as lo, y.tok as hi, count(*) as n12 from du x join du y on x.doc = y.doc and x.tok < y.tok group by all)"
_INTREE = f"{_PAIR}, {_DOCP}, n as (select tok, count(*) as n from toks group by 1), tot as (select count(*)::double as total from toks), ps as (select topic, w1, w2, coalesce(a.n, 1) / total as p1, coalesce(b.n, 1) / total as p2, coalesce(n12, 1) / total as p12 from wp left join dn using (lo, hi) left join n a on a.tok = w1 left join n b on b.tok = w2, tot), sc as (select topic, w1, w2, log2(p12 / (p1 * p2)) / -log2(p12) as npmi, log2(p12 / (p1 * p2)) as pmi, log2(p12 / p2) as lc from ps)"


@query(f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {_TRAIN}, {_WORDSQL}, {_INTREE} select topic, w1, w2, round(npmi, 6) as npmi, round(pmi, 6) as pmi, round(lc, 6) as lc from sc")
def coherence_pairs(spark, sf_dir):
    s = H.pair_scores(_tokens(spark, sf_dir), _words(spark, sf_dir))
    return s.select("topic", "w1", "w2", *[F.round(m, 6).alias(m) for m in H.MEASURES])


@query(f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {_TRAIN}, {_WORDSQL}, {_INTREE} select topic, round(avg(npmi), 6) as coherence from sc group by topic")
def coherence_npmi(spark, sf_dir):
    s = H.pair_scores(_tokens(spark, sf_dir), _words(spark, sf_dir))
    return H.topic_coherence(s, "npmi").select("topic", F.round("coherence", 6).alias("coherence"))


_WIN = f"{_PAIR}, ln as (select doc, max(pos) as last from toks group by 1), tot as (select sum(greatest(last - 9, 1))::double as total from ln), un as (select distinct doc, tok, unnest(range(greatest(pos - 9, 1), least(pos, greatest(last - 9, 1)) + 1)) as w from toks join ln using (doc) where tok in (select num from tw where place <= 10)), uc as (select tok, count(*) as n from un group by 1), up as (select x.tok as lo, y.tok as hi, count(*) as n12 from un x join un y on x.doc = y.doc and x.w = y.w and x.tok < y.tok group by all), uw as (select topic, ln((coalesce(n12, 0) / total + 1e-12) / ((a.n / total) * (b.n / total))) as u, coalesce(n12, 0) / total as p12 from wp left join up using (lo, hi) join uc a on a.tok = w1 join uc b on b.tok = w2, tot), cw as (select topic, avg(u / -ln(p12 + 1e-12)) as c_npmi, avg(u) as c_uci from uw group by topic)"


@query(f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {_TRAIN}, {_WORDSQL}, {_WIN} select topic, round(c_npmi, 6) as c_npmi, round(c_uci, 6) as c_uci from cw")
def coherence_uci(spark, sf_dir):
    return H.window_coherence(materialise(_tokens(spark, sf_dir)), _words(spark, sf_dir)).select("topic", F.round("c_npmi", 6).alias("c_npmi"), F.round("c_uci", 6).alias("c_uci"))


_UM = f"{_DOCP}, nd as (select count(distinct doc)::double as nd from toks), d1 as (select tok, count(*) as n1 from du group by 1), um as (select topic, avg(ln((coalesce(n12, 0) / nd + 1e-12) / (n1 / nd))) as u_mass from wp left join dn using (lo, hi) join d1 on d1.tok = w1, nd group by topic)"


@query(f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {_TRAIN}, {_WORDSQL}, {_PAIR}, {_UM} select topic, round(u_mass, 6) as u_mass from um")
def coherence_umass(spark, sf_dir):
    return H.umass(materialise(_tokens(spark, sf_dir)), _words(spark, sf_dir)).select("topic", F.round("u_mass", 6).alias("u_mass"))


@query(f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {_TRAIN}, {_WORDSQL}, {_WIN}, {_UM}, o as (select (select count(distinct num)::double / count(*) from tw where place <= 25) as d, (select avg(c_npmi) from cw) as n, (select avg(c_uci) from cw) as u, (select avg(u_mass) from um) as m) select round(d, 4) as diversity, round(n, 4) as c_npmi, round(u, 4) as c_uci, round(m, 4) as u_mass, round(n * d, 4) as quality_c_npmi, round(u * d, 4) as quality_c_uci, round(m * d, 4) as quality_u_mass from o")
def model_statistics(spark, sf_dir):
    return H.statistics(materialise(_tokens(spark, sf_dir)), _words(spark, sf_dir))


# --- reports

_NAMED = f"{Q.KB}, {Q.ENTITY_VECTORS}, {_TRAIN}, {_WORDSQL}, tl as (select topic, place, tw.num, coalesce(label, '<NO TRANSLATION>') as label, score from tw left join (select num, label from labels_ where lang = 'en') using (num))"


def _named(spark, sf_dir) -> DataFrame:
    return K.translated(_words(spark, sf_dir), "num", knowledge(spark, sf_dir), "en")


@query(f"with {_NAMED} select topic, " + ", ".join(f"max(num) filter (place = {i}) as id_{i}, max(label) filter (place = {i}) as word_{i}, round(max(score) filter (place = {i}), 6) as score_{i}" for i in range(1, 6)) + " from tl where score > 1e-4 group by topic")
def topics_wide(spark, sf_dir):
    w = R.wide(_named(spark, sf_dir), 5, 1e-4)
    return w.select("topic", *[F.round(c, 6).alias(c) if c.startswith("score") else F.col(c) for c in w.columns if c != "topic"])


@query(f"with {_NAMED} select topic, '{{\"FeatureWords\":[' || string_agg('\"' || label || '\"', ',' order by place) || '],\"TopicID\":\"' || lpad(topic::varchar, 6, '0') || '\"}}' as json from tl where place <= 25 group by topic")
def topics_json(spark, sf_dir):
    return R.as_json(_named(spark, sf_dir))


@query(f"with {_NAMED} select topic, '| ' || topic || ' | ' || string_agg(label || ' (' || printf('%.3f', score) || ')', ', ' order by place) || ' |' as line from tl where place <= 10 group by topic")
def topics_markdown(spark, sf_dir):
    return R.as_markdown(_named(spark, sf_dir))


@query(f"with {_NAMED} select topic, place, upper(label) as word, round(score, 6) as score from tl where place <= 25")
def topics_upper(spark, sf_dir):
    return R.upper_words(_named(spark, sf_dir))


@query(f"with {_DVEC}, {_TRAIN}, {_PROB} select doc_id, " + ", ".join(f"max(topic || ' (' || printf('%.3f', prob) || ')') filter (place = {i}) as topic_{i}" for i in (1, 2, 3)) + " from dt group by doc_id")
def corpus_report(spark, sf_dir):
    return R.document_report(_doc_topics(spark, sf_dir, 3)[3], 3)


@query(f"with {Q.ENTITY_VECTORS}, {_TRAIN}, {_WORDSQL} select t.topic, w.num, round(coalesce(score, 0), 6) as weight from (select distinct topic from tw) t, (select distinct num from tw) w left join tw on tw.topic = t.topic and tw.num = w.num")
def weights_matrix(spark, sf_dir):
    """Every topic's weight of every word of any topic."""
    return R.weights(_words(spark, sf_dir)).select("topic", "num", F.round("weight", 6).alias("weight"))


# --- the same on topics trained as the reference trains them


def _trained_fully(f) -> None:
    """Registers the query `f` once more, on the reference's number of topics, of words, and of rounds at most; without SQL."""

    def run(spark, sf_dir):
        before = _TRAINING.set(Training(REFERENCE_TOPICS, REFERENCE_ROUNDS, REFERENCE_WORDS))
        try:
            return f(spark, sf_dir)  # the model is trained while the query is built
        finally:
            _TRAINING.reset(before)

    run.__name__ = f"{f.__name__}_full"
    run.__doc__ = f"`{f.__name__}` on topics of the reference's size, trained until nothing moves."
    query()(run)


for _f in (doc_top_topic, top_topics_words, topic_word_update_hard, topic_word_update_soft, topic_diversity, coherence_npmi, coherence_uci, coherence_umass, model_statistics, topics_wide, topics_json, corpus_report):
    _trained_fully(_f)


@query()
def lda_baseline(spark, sf_dir):
    """Words of topics by LDA over the pages' entities, a baseline: sampled as the reference samples them, every sweep over all tokens."""
    from pyspark.ml.feature import CountVectorizer

    if not _tokens(spark, sf_dir).limit(1).count():
        return spark.createDataFrame([], "topic int, place int, word string, score double")
    bags = _tokens(spark, sf_dir).groupBy("doc").agg(F.collect_list(F.col("tok").cast("string")).alias("tokens"))  # a page's own list
    distinct = _tokens(spark, sf_dir).agg(F.count_distinct("tok")).first()[0]
    counts = CountVectorizer(inputCol="tokens", outputCol="features", minDF=1.0, vocabSize=distinct).fit(bags)  # every id
    vector = F.unwrap_udt("features")
    rows = materialise(counts.transform(bags).select(vector["indices"].alias("words"), vector["values"].alias("counts")))
    found = G.topic_counts(rows, distinct, REFERENCE_TOPICS, REFERENCE_SWEEPS)
    vocabulary = spark.createDataFrame(list(enumerate(counts.vocabulary)), "i int, word string")
    return G.words(found, distinct, REFERENCE_TOPICS, 25).join(vocabulary, "i").select("topic", "place", "word", "score")
