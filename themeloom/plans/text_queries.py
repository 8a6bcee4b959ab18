"""Queries over texts, vectors, bags and ordered corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions.lemmatizers import lemmatizer
from ..operators import bags as B
from ..operators import corpus as C
from ..operators import vectors as V
from ..session import spread
from .catalog import query, table
from .kb_queries import _UPPER, _title

_V = "list_transform({0}, lambda x: x::double)"
_NEXT = "a as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), pair as (select x.vec_id, x.a as a, y.a as b from a x join a y on y.vec_id = x.vec_id + 1)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))  # a small table in one file would keep one core busy only


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query(f"with {_NEXT} select vec_id, round({_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})), 6) as value from pair")
def cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(S.cosine(F.col("a"), F.col("b")), 6).alias("value"))


@query(f"with {_NEXT}, c as (select vec_id, list_transform(a, lambda x: x - list_avg(a)) as a, list_transform(b, lambda x: x - list_avg(b)) as b from pair) select vec_id, round({_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})), 6) as value from c")
def pearson(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(S.pearson(F.col("a"), F.col("b")), 6).alias("value"))


@query(f"with {_NEXT} select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as value from pair")
def squared_l2(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(S.squared_l2(F.col("a"), F.col("b")), 6).alias("value"))


@query(f"""with p as (select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by all), c as (select label, list(m order by i) as v from p group by label)
select a.label as label_a, b.label as label_b, round({_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')})), 6) as value from c a, c b""")
def cosine_gram(spark, sf_dir):
    """Similarities of all classes' mean vectors with each other: a matrix of a bounded number of rows."""
    c = V.weighted_mean(table(spark, sf_dir, "embeddings").select("label", "embedding"), "label", "embedding", 64)
    return V.gram(c, "label", "vec").select(F.col("a").alias("label_a"), F.col("b").alias("label_b"), F.round("cosine", 6).alias("value"))


_SETS = "w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')) as s from documents), p as (select x.doc_id, x.s as a, y.s as b, len(list_intersect(x.s, y.s))::double as n from w x join w y on y.doc_id = x.doc_id + 1)"


def _sets(spark, sf_dir):
    w = _documents(spark, sf_dir).select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("a"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


@query(f"with {_SETS} select doc_id, round(n / sqrt(nullif(len(a) * len(b), 0)), 6) as value from p")
def cosine_set(spark, sf_dir):
    return _sets(spark, sf_dir).select("doc_id", F.round(S.cosine_set(F.col("a"), F.col("b")), 6).alias("value"))


@query(f"with {_SETS} select doc_id, round(n / nullif(len(a) + len(b) - n, 0), 6) as value from p")
def jaccard(spark, sf_dir):
    return _sets(spark, sf_dir).select("doc_id", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("value"))


@query(f"with {_SETS} select doc_id, round(n / nullif(least(len(a), len(b)), 0), 6) as value from p")
def overlap_coef(spark, sf_dir):
    return _sets(spark, sf_dir).select("doc_id", F.round(S.overlap_coefficient(F.col("a"), F.col("b")), 6).alias("value"))


_WORDS = "w as (select item_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '') as t from eval_item)"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "eval_item").select("item_id", "text", T.words(F.col("text")).alias("t"))


@query(f"with {_WORDS} select gram, count(*) as n from (select array_to_string(t[i : i + 1], ' ') as gram from (select t, unnest(range(1, len(t))) as i from w)) group by gram")
def ngrams(spark, sf_dir):
    return _words(spark, sf_dir).select(F.explode(T.ngrams(F.col("t"), 2)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_WORDS} select gram, count(*) as n from (select array_to_string(t[i : i + k - 1], ' ') as gram from (select t, unnest(range(1, len(t) + 1)) as i from w), (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(t)) group by gram")
def allngrams(spark, sf_dir):
    return _words(spark, sf_dir).select(F.explode(T.all_ngrams(F.col("t"), 3)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query("select shingle, count(*) as n from (select text[i : i + 4] as shingle from (select text, unnest(range(1, length(text) - 3)) as i from eval_item)) group by shingle")
def kshingles(spark, sf_dir):
    return table(spark, sf_dir, "eval_item").select(F.explode(T.shingles(F.col("text"), 5)).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_WORDS} select item_id, i - 1 as window_no, array_to_string(t[i : i + 9], ' ') as words from (select item_id, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) as i from w)")
def sliding_windows(spark, sf_dir):
    return _words(spark, sf_dir).select("item_id", F.posexplode(T.sliding_windows(F.col("t"), 10)).alias("window_no", "w")).select("item_id", F.col("window_no").cast("bigint").alias("window_no"), F.array_join("w", " ").alias("words"))


# --- the same four over the documents

_DOCWORDS = "w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '') as t from documents)"


def _doc_words(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("t"))


@query(f"with {_DOCWORDS} select gram, count(*) as n from (select array_to_string(t[i : i + 1], ' ') as gram from (select t, unnest(range(1, len(t))) as i from w)) group by gram")
def ngrams_documents(spark, sf_dir):
    return _doc_words(spark, sf_dir).select(F.explode(T.ngrams(F.col("t"), 2)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DOCWORDS} select gram, count(*) as n from (select array_to_string(t[i : i + k - 1], ' ') as gram from (select t, unnest(range(1, len(t) + 1)) as i from w), (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(t)) group by gram")
def allngrams_documents(spark, sf_dir):
    return _doc_words(spark, sf_dir).select(F.explode(T.all_ngrams(F.col("t"), 3)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query("select shingle, count(*) as n from (select text[i : i + 4] as shingle from (select text, unnest(range(1, length(text) - 3)) as i from documents)) group by shingle")
def kshingles_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.explode(T.shingles(F.col("text"), 5)).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DOCWORDS} select doc_id, i - 1 as window_no, array_to_string(t[i : i + 9], ' ') as words from (select doc_id, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) as i from w)")
def sliding_windows_documents(spark, sf_dir):
    return _doc_words(spark, sf_dir).select("doc_id", F.posexplode(T.sliding_windows(F.col("t"), 10)).alias("window_no", "w")).select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.array_join("w", " ").alias("words"))


@query("select doc_id, md5(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')) as digest from documents")
def remove_punct(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(T.remove_punctuation(F.col("text")), "UTF-8")).alias("digest"))


@query("select doc_id, case when starts_with(title, 'A') then title[2:] else title end as title, array_to_string((list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> ''))[1:8], ' ') as head, translate(text, chr(10), ' ') = text as one_line from documents")
def prefix_and_head(spark, sf_dir):
    c = F.col
    return _documents(spark, sf_dir).select("doc_id", T.remove_prefix(c("title"), "A").alias("title"), T.first_words(c("text"), 8).alias("head"), (T.newlines_to_spaces(c("text")) == c("text")).alias("one_line"))


@query("select doc_id, md5(replace(regexp_replace(' ' || replace(text, '.', '.' || chr(1)), '([^\\w\\pL\\pN\\pM_])([A-Z])\\.', '\\1\\2', 'g')[2:], chr(1), '')) as digest from documents")
def acronym(spark, sf_dir):
    """Every text; in the SQL a mark behind each dot stands in for the look-behind that its dialect lacks."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(T.acronyms(F.col("text")), "UTF-8")).alias("digest"))


@query("select doc_id, md5(regexp_replace(text, '([''’])', ' \\1', 'g')) as digest, md5(replace(regexp_replace(text, '([!-/:-@\\[-`{-~])', ' \\1', 'g'), '’', ' ’')) as digest_all from documents")
def apostrophe_space(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(T.space_apostrophes(t), "UTF-8")).alias("digest"), F.md5(F.encode(T.space_apostrophes(t, True), "UTF-8")).alias("digest_all"))


_RU = "array_to_string(list_filter(regexp_split_to_array(replace(regexp_replace(text, '([!-/:-@\\[-`{-~])', ' \\1', 'g'), '’', ' ’'), '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> ''), ' ')"


@query(f"select doc_id, md5(replace(regexp_replace(' ' || replace({_RU}, '.', '.' || chr(1)), '([^\\w\\pL\\pN\\pM_])([A-Z])\\.', '\\1\\2', 'g')[2:], chr(1), '')) as digest from documents")
def lemmatized(spark, sf_dir):
    """Texts through the preprocessing of a language whose words are their own lemmas."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(lemmatizer("ru")(F.col("text")), "UTF-8")).alias("digest"))


_W = "w as (select distinct unnest(regexp_extract_all(text, '[\\pL]+')) as word from documents)"


@query(f"with {_W} select word, case when lower(word) = word and upper(word) <> word then regexp_replace(regexp_replace(word, '[dt][ae]n$', ''), 'l[ae]r$', '') else word end as stem from w")
def turkish_suffix(spark, sf_dir):
    w = _documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    return w.select("word", T.turkish_suffixes(F.col("word")).alias("stem"))


_PLAIN = "replace(word, 'ß', 's')"  # one letter in upper case there, two here: neither is upper case nor begins a title


@query(f"with {_W} select word, case when {_UPPER.format(_PLAIN)} and instr(word, 'ß') = 0 then word when {_title(_PLAIN)} = {_PLAIN} and lower(word) <> word and word[1] <> 'ß' then {_title('lower(word[:3])')} else lower(word[:3]) end as lemma from w")
def title_case_restore(spark, sf_dir):
    w = _documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    return w.select("word", T.restore_case(F.lower(F.substring("word", 1, 3)), F.col("word")).alias("lemma"))


# --- bags of whole tables: how often each user did what; events of users against orders of the customers with the same number, by weekday

_USES = "l as (select user_id as owner, event_type as key, count(*)::double as a from events where user_id is not null and event_type is not null group by all)"
_DAYS = """l as (select user_id as owner, dayofweek(ts) + 1 as key, count(*)::double as a from events where user_id is not null and ts is not null group by all), r as (select o_custkey as owner, dayofweek(o_orderdate) + 1 as key, count(*)::double as b from orders where o_custkey is not null and o_orderdate is not null group by all),
f as (select coalesce(l.owner, r.owner) as owner, coalesce(l.key, r.key) as key, coalesce(a, 0) as a, coalesce(b, 0) as b from l full join r on l.owner = r.owner and l.key = r.key)"""


def _uses(spark, sf_dir):
    return B.bag(table(spark, sf_dir, "events"), "user_id", "event_type")


def _days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.dayofweek("ts").alias("day"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.dayofweek("o_orderdate").alias("day"))
    return B.bag(e, "user_id", "day"), B.bag(o, "o_custkey", "day")


def _days_query(operation: str, formula: str, intersection: bool = False):
    def run(spark, sf_dir):
        left, right = _days(spark, sf_dir)
        return B.combine(left, right, operation, intersection).select("owner", "key", F.round("value", 6).alias("value"))

    run.__name__ = f"bag_{operation}" + ("_common" if intersection else "") + ""
    query(f"with {_DAYS} select owner, key, round({formula}, 6) as value from " + ("(select l.owner, l.key, a, b from l join r on l.owner = r.owner and l.key = r.key)" if intersection else "f"))(run)


for _name, _formula in (("add", "a + b"), ("sub", "a - b"), ("mul", "a * b"), ("div", "a / nullif(b, 0)"), ("floordiv", "floor(a / nullif(b, 0))"), ("mod", "a - b * floor(a / nullif(b, 0))"), ("pow", "pow(a, b)")):
    _days_query(_name, _formula)
_days_query("mul", "a * b", True)


@query(f"with {_DAYS} select owner, sum(a * b) as value from l join r using (owner, key) group by owner")
def bag_inner(spark, sf_dir):
    return B.inner(*_days(spark, sf_dir))


_SIGNS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}
_REFLECTED = {"floordiv": "floor(1000 / a)", "div": "1000 / a", "mod": "1000 - a * floor(1000 / a)", "pow": "pow(1.01, a)", "sub": "1000 - a"}


@query(f"with {_USES} select owner, key, -(7 % a) as value from l")
def bag_scalar(spark, sf_dir):
    return B.negate(B.scalar(_uses(spark, sf_dir), "mod", 7, reflected=True))


@query(f"with {_USES} " + " union all ".join(f"select owner, key, round({formula}, 6) as value, '{name}' as kind from l" for name, formula in _REFLECTED.items()))
def bag_reflected(spark, sf_dir):
    """A number as the left operand of every operation that isn't symmetric."""
    uses = B.bag(table(spark, sf_dir, "events"), "user_id", "event_type")
    parts = [B.scalar(uses, name, 1.01 if name == "pow" else 1000, reflected=True).select("owner", "key", F.round("value", 6).alias("value"), F.lit(name).alias("kind")) for name in _REFLECTED]
    return reduce(DataFrame.unionByName, parts)


@query(f"with {_USES} " + " union all ".join(f"select owner, key, a as value, '{name}' as kind from l where a {sign} 20" for name, sign in _SIGNS.items()))
def bag_compare(spark, sf_dir):
    uses = _uses(spark, sf_dir)
    return reduce(DataFrame.unionByName, [B.compare(uses, name, 20).withColumn("kind", F.lit(name)) for name in _SIGNS])


@query(f"with {_USES} select owner, key, a as value from l where a >= 20 and key <> 'click'")
def bag_filtered(spark, sf_dir):
    return B.filtered(_uses(spark, sf_dir), lambda k: k != "click", lambda v: v >= 20)


@query(f"with {_USES} select owner, key, round(v, 6) as value, place from (select owner, key, a / sum(a) over (partition by owner) as v, row_number() over (partition by owner order by a desc, key)::integer as place from l) where place <= 3")
def bag_normalised(spark, sf_dir):
    return B.normalised_rows(_uses(spark, sf_dir), 3).select("owner", "key", F.round("value", 6).alias("value"), "place")


@query(f"with {_USES} select owner, sum(a) as total, sum(a) filter (where place <= 2) as head_total from (select *, row_number() over (partition by owner order by a desc, key) as place from l) group by owner")
def bag_sums(spark, sf_dir):
    uses = _uses(spark, sf_dir)
    total = uses.groupBy("owner").agg(F.sum("value").alias("total"))
    return total.join(B.head(uses, 2).groupBy("owner").agg(F.sum("value").alias("head_total")), "owner")


@query(f"with {_USES} select owner, bool_or(a > 24) as holds from l group by owner")
def bag_holds(spark, sf_dir):
    return B.holds_any(_uses(spark, sf_dir), "gt", 24)


@query(f"with {_USES} select owner, key, round(a / sum(a) over (partition by owner), 6) as value from l")
def bag_freq(spark, sf_dir):
    return B.frequencies(_uses(spark, sf_dir)).select("owner", "key", F.round("value", 6).alias("value"))


@query(f"with {_USES} select owner, key, a as value, place from (select *, row_number() over (partition by owner order by a desc, key)::integer as place from l) where place <= 2")
def bag_head(spark, sf_dir):
    return B.head(_uses(spark, sf_dir), 2)


@query(f"with {_USES} select owner, key, a as value, place from (select *, row_number() over (partition by owner order by a, key desc)::integer as place from l) where place <= 2")
def bag_tail(spark, sf_dir):
    return B.tail(_uses(spark, sf_dir), 2)


# --- ordered corpora: the documents in the order of their numbers

_POS = "c as (select row_number() over (order by doc_id) - 1 as pos, doc_id, title, text, source from documents)"


def _corpus(spark, sf_dir):
    return C.renumbered(table(spark, sf_dir, "documents").select("doc_id", "title", "text", "source"), F.col("doc_id"))


_RANKED = f"{_POS}, r as (select *, row_number() over (order by md5('7-' || pos), pos) - 1 as rank from c)"


@query(f"with {_RANKED} select doc_id, pos, rank < floor((select count(*) from c) * 0.3) as first_part from r")
def corpus_split(spark, sf_dir):
    a, b = C.split(_corpus(spark, sf_dir), 0.3, 7)
    return a.select("doc_id", "pos", F.lit(True).alias("first_part")).union(b.select("doc_id", "pos", F.lit(False)))


@query(f"with {_RANKED} select doc_id, rank as pos from r")
def corpus_shuffle(spark, sf_dir):
    return C.shuffled(_corpus(spark, sf_dir), 7).select("doc_id", "pos")


@query(f"with {_POS}, en as (select doc_id, row_number() over (order by pos) - 1 as pos from c where coalesce(source, '') <> '' and length(text) > 1000), n as (select max(pos) + 1 as n from en) select doc_id, pos, pos // 100 as chunk from (select doc_id, pos from en union all select doc_id, pos + n from c, n)")
def corpus_filter_concat(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    kept = C.filtered(c.where("coalesce(source, '') <> ''"), "text", lambda t: F.length(t) > 1000)
    return C.chunks(C.concatenated(kept, c), 100).select("doc_id", "pos", "chunk")


@query(f"with {_POS} select pos, doc_id * 2 as double_id, md5(repeat(coalesce(title, '') || ' ', 5) || coalesce(text, '')) as digest, upper(source) as source from c")
def corpus_add_apply(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    added = C.add_column(c, c.select("pos", (F.col("doc_id") * 2).alias("value")), "double_id")
    return C.apply(added, "source", F.upper).select("pos", "double_id", F.md5(F.encode(C.as_text(F.col("title"), F.col("text"), 5), "UTF-8")).alias("digest"), "source")
