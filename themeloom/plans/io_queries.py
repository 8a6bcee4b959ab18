"""Round trips: tables written by a sink and read back by its source, and models saved, loaded and asked. What comes back is compared with what the SQL finds in the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import entity_number, entity_numbers
from ..model import EntityMatcher, TopicModel
from ..operators import kb as K
from ..operators import reports as R
from ..operators import topics as T
from ..operators import walks as W
from ..operators.states import latest_state
from ..session import checkpoint_dir, materialise
from ..sources import dump, files, workbook
from . import sql as Q
from . import topic_queries as TQ
from .catalog import query, table
from .kb_queries import knowledge


def scratch(spark: SparkSession) -> str:
    """A folder of its own below the one that all executors share."""
    return f"{checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"


def _titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("title is not null").select(F.translate("title", "\r\n", "  ").alias("value"))


_TITLES = "titles as (select translate(title, chr(13) || chr(10), '  ') as value from documents where title is not null)"


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_TITLES} select value, count(*) as n from titles group by value")
def io_lines(spark, sf_dir):
    """Lines written and read."""
    path = scratch(spark)
    files.write_lines(_titles(spark, sf_dir), path)
    return _counted(files.read_lines(spark, path))


@query(f"with {_TITLES} select value, 2 * count(*) as n from titles group by value")
def io_lines_appended(spark, sf_dir):
    path = scratch(spark)
    for again in (False, True):
        files.write_lines(_titles(spark, sf_dir), path, append=again)
    return _counted(files.read_lines(spark, path))


@query(f"with {_TITLES} select value, count(*) as n from titles group by value")
def io_lines_compressed(spark, sf_dir):
    """The same compressed by bzip2."""
    path = scratch(spark)
    files.write_lines(_titles(spark, sf_dir), path, compression="bzip2")
    return _counted(files.read_lines(spark, path))


@query(f"with {_TITLES} select '> ' || value as value, count(*) as n from titles where length(value) > 12 group by 1")
def io_map_file(spark, sf_dir):
    """A file mapped line by line to another; lines mapped to null are left out."""
    path = scratch(spark)
    files.write_lines(_titles(spark, sf_dir), f"{path}/a")
    files.map_file(spark, f"{path}/a", f"{path}/b", lambda c: F.when(F.length(c) > 12, F.concat(F.lit("> "), c)))
    return _counted(files.read_lines(spark, f"{path}/b"))


@query("select doc_id, regexp_replace(title, '[^\\x00-\\xFF]', '?', 'g') as title, lang from documents")
def io_csv_latin1(spark, sf_dir):
    """A CSV file in ISO-8859-1 with quotes; a character beyond it comes back as a question mark."""
    path = scratch(spark)
    table(spark, sf_dir, "documents").select("doc_id", "title", "lang").write.option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return files.read_csv(spark, path, "doc_id bigint, title string, lang string")


@query("select p_partkey, p_name, p_retailprice from part")
def io_csv_config(spark, sf_dir):
    """A CSV file with a header line."""
    path = scratch(spark)
    files.write_merged_counts(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return files.read_config_csv(spark, path, "p_partkey bigint, p_name string, p_retailprice double")


_SUMMARY = "rec_no bigint, id string, enwiki string, labels string"


@query("select rec_no, id, enwiki, labels from wikidata_summary")
def io_json_lines(spark, sf_dir):
    """JSON lines, read strictly."""
    path = scratch(spark)
    files.write_json(table(spark, sf_dir, "wikidata_summary").select("rec_no", "id", "enwiki", "labels"), path)
    return files.read_jsonl(spark, path, _SUMMARY, strict=True)


@query("select rec_no, id, enwiki, labels from wikidata_summary where enwiki is not null")
def io_json_lines_damaged(spark, sf_dir):
    """JSON lines, damaged for the records without a page; those are left out."""
    path = scratch(spark)
    row = F.to_json(F.struct("rec_no", "id", "enwiki", "labels"))
    files.write_lines(table(spark, sf_dir, "wikidata_summary").select(F.when(F.col("enwiki").isNull(), F.substring(row, F.lit(1), F.length(row) - 2)).otherwise(row)), path)
    return files.read_jsonl(spark, path, _SUMMARY)


@query("select alias, id, lang, reason, count(*) as n from labels_patch group by all")
def io_json_value(spark, sf_dir):
    """A file that is one JSON value, as configurations are: the patches, a table of fixed size, as an array."""
    path = scratch(spark)
    table(spark, sf_dir, "labels_patch").agg(F.to_json(F.collect_list(F.struct("alias", "id", "lang", "reason"))).alias("value")).write.text(path)
    return files.read_json(spark, path, "alias string, id string, lang string, reason string").groupBy("alias", "id", "lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("select rec_no, id, enwiki, labels from wikidata_summary")
def io_dump(spark, sf_dir):
    """A dump: one JSON array, an object a line."""
    path = scratch(spark)
    row = F.concat(F.to_json(F.struct("rec_no", "id", "enwiki", "labels")), F.lit(","))
    bracket = lambda b: spark.createDataFrame([(b,)], "value string")
    files.write_lines(bracket("[").union(table(spark, sf_dir, "wikidata_summary").select(row)).union(bracket("]")), path)
    return files.read_dump(spark, path).select(F.from_json("value", _SUMMARY).alias("r")).select("r.*")


@query(f"with {Q.RECORDS}, {Q.items(['labels'])}, one as (select rec, item_key, min_by(item, item_pos) as label from items group by all) select rec as num, item_key as lang, label from one where item_key in ('en', 'fr', 'de', 'pl', 'ru', 'tr', 'es', 'pt', 'ms', 'ar', 'it', 'th')")
def io_dump_summary(spark, sf_dir):
    """Labels written in the form of a raw dump, and summarised from it."""
    path = scratch(spark)
    labels = knowledge(spark, sf_dir).labels
    of = F.map_from_entries(F.collect_list(F.struct("lang", F.struct(F.col("label").alias("value")))))
    records = labels.groupBy("num").agg(of.alias("labels")).select(F.concat(F.to_json(F.struct(F.concat(F.lit("Q"), "num").alias("id"), "labels")), F.lit(",")).alias("value"))
    files.write_lines(records, path)
    return dump.summarise_dump(files.read_dump(spark, path)).select(entity_number("id").alias("num"), F.explode("labels").alias("lang", "label"))


@query("select vec_id::varchar as id, i::integer as dim, round(round(embedding[i]::double, 8)::float::double, 6) as value from embeddings, (select unnest(range(1, 65)) as i)")
def io_embeddings(spark, sf_dir):
    """Embedding lines below their header."""
    path = scratch(spark)
    files.write_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec")), path, 64)
    return files.read_embeddings(spark, path).select("id", F.posexplode("vec").alias("p", "v")).select("id", (F.col("p") + 1).alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("select src, dst, count(*) as n from edges where src is not null group by all")
def io_edges(spark, sf_dir):
    """The edge file, whole."""
    path = scratch(spark)
    files.write_edges(table(spark, sf_dir, "edges").where("src is not null"), path)
    return files.read_edges(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("select entity as value, row_number() over (order by qrank desc, entity) - 1 as rank from (select entity, max(qrank) as qrank from qrank where entity is not null group by 1)")
def io_ranked(spark, sf_dir):
    """A file whose order is the rank."""
    path = scratch(spark)
    best = table(spark, sf_dir, "qrank").where("entity is not null").groupBy("entity").agg(F.max("qrank").alias("qrank"))
    best.orderBy(F.desc("qrank"), "entity").write.option("header", True).csv(path)
    return files.read_ranked(spark, path, "entity")


@query("select event_type, user_id, count(*) as n from events group by all")
def io_cached(spark, sf_dir):
    """A table computed once and read from then on: the second computation would raise."""
    path = scratch(spark)
    files.cached(spark, path, lambda: table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")))
    return files.cached(spark, path, lambda: spark.range(1).select(F.raise_error(F.lit("computed twice"))))


_ALIGNED = f"{Q.PAGES}, al as (select translate(coalesce(text, ''), chr(13) || chr(10), '  ') as t, coalesce(array_to_string(list_transform(list_filter(list_transform(text_entities, lambda x: {Q.idno('x')}), lambda x: x is not null), lambda x: 'Q' || x), ' '), '') as l from curp)"


@query(f"with {_ALIGNED} select md5(t) as digest, l as entities, count(*) as n from al group by all")
def io_aligned(spark, sf_dir):
    """Texts and entities in two files that belong together by position."""
    path = scratch(spark)
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"text": F.col("text"), "l": F.transform(entity_numbers("text_entities"), lambda x: F.concat(F.lit("Q"), x))})
    files.write_aligned(now, "text", "l", path)
    back = files.read_aligned(spark, path)
    return back.groupBy(F.md5(F.encode("text", "UTF-8")).alias("digest"), F.array_join("entities", " ").alias("entities")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {Q.RECORDS}, {Q.PAGES} select num, array_to_string(list_transform(coalesce(list_filter(list_transform(text_entities, lambda x: {Q.idno('x')}), lambda x: x is not null), [num]), lambda x: 'Q' || x), ' ') as line from curp")
def text_entities_or_own(spark, sf_dir):
    """The entities listed for each page, its own where there is no list."""
    now = latest_state(table(spark, sf_dir, "wiki_page"), entity_number("id"), "scraped_at", "page_no", {"l": entity_numbers("text_entities")})
    return now.select(F.col("key").alias("num"), F.array_join(F.transform(K.listed_or_own(F.col("key"), F.col("l")), lambda x: F.concat(F.lit("Q"), x)), " ").alias("line"))


@query(f"with {Q.KB}, ranked as (select distinct {Q.idno('entity')} as num from qrank) select num, lang, substr(label, 1, case when instr(label, ' (') > 0 then instr(label, ' (') - 1 else length(label) end) as label from labels_ where num in (select num from ranked)")
def kb_by_ids(spark, sf_dir):
    """The knowledge base about given ids: those with a popularity."""
    ids = table(spark, sf_dir, "qrank").select(entity_number("entity").alias("num")).where("num is not null")
    return K.by_ids(knowledge(spark, sf_dir), ids).labels.select("num", "lang", "label")


# --- walks over the edge file

_LINKS = f"links as (select {Q.idno('src')} as src, {Q.idno('dst')} as dst from edges), good as (select distinct src, dst from links where src is not null and dst is not null and src <> dst), nodes as (select src as num from links where src is not null union select dst from links where dst is not null)"


def _links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "edges").select(entity_number("src").alias("src"), entity_number("dst").alias("dst"))


@query(f"with {_LINKS} select src as num, count(*) as n, count(*) - 1 as last, count(*) as numbers from good group by src")
def walk_degrees(spark, sf_dir):
    """How many neighbours each node has, and that they are numbered without gaps."""
    near = W.neighbours(_links(spark, sf_dir), "src", "dst")
    return near.groupBy(F.col("node").alias("num"), "n").agg(F.max("i").alias("last"), F.count_distinct("i").alias("numbers"))


@query(f"with {_LINKS} select num, num in (select src from good) as moved, true as along_edges, true as goes_on from nodes")
def walk_steps(spark, sf_dir):
    """What every walk must keep: it leaves a node that has neighbours, steps along edges only, and ends early only where there is no way on."""
    links = materialise(_links(spark, sf_dir))
    walks = materialise(W.random_walks(links, "src", "dst", 6))
    good = links.where("src <> dst").select("src", "dst").distinct().withColumn("known", F.lit(True))
    steps = walks.where("size(path) > 1").select("start", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("src"), F.slice("path", F.lit(2), F.size("path") - 1).alias("dst"))).alias("s")).select("start", "s.src", "s.dst")
    along = steps.join(good, ["src", "dst"], "left").groupBy("start").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("along"))
    leads = good.select(F.col("src").alias("last")).distinct().withColumn("leads", F.lit(True))
    rows = walks.withColumn("last", F.element_at("path", -1)).join(leads, "last", "left").join(along, "start", "left")
    return rows.select(F.col("start").alias("num"), (F.size("path") > 1).alias("moved"), F.coalesce("along", F.lit(True)).alias("along_edges"), ((F.size("path") == 6) | F.col("leads").isNull()).alias("goes_on"))


@query(f"with {_LINKS} select num, 16 as dims from nodes")
def walk_embeddings(spark, sf_dir):
    """A vector for every node of the edge file."""
    return W.walk_vectors(W.random_walks(_links(spark, sf_dir), "src", "dst", 6), 16).select("num", F.size("vec").alias("dims"))


# --- models


def _trained(spark, sf_dir) -> tuple[DataFrame, TopicModel]:
    vectors, c = TQ._model(spark, sf_dir)
    return vectors, TopicModel(materialise(T.topic_words(vectors, c, TQ.WORDS)), c, {0: "first"})


def _reloaded(spark, sf_dir) -> tuple[DataFrame, TopicModel]:
    vectors, model = _trained(spark, sf_dir)
    path = scratch(spark)
    model.save(path)
    return vectors, TopicModel.load(spark, path)


_MODEL = f"{Q.ENTITY_VECTORS}, {TQ._TRAIN}, {TQ._WORDSQL}"
_DOCS = f"{TQ._DVEC}, {TQ._TRAIN}, {TQ._PROB}"


@query(f"with {_MODEL} select topic, case when topic = 0 then 'first' else topic::varchar end as label, place, num, round(score, 6) as score from tw")
def model_saved(spark, sf_dir):
    """Topic words and labels of a model that was saved and loaded."""
    model = _reloaded(spark, sf_dir)[1]
    label = F.element_at(F.array(*[F.lit(model.label(t)) for t in range(model.num_topics)]), F.col("topic") + 1)
    return model.words.select("topic", label.alias("label"), "place", "num", F.round("score", 6).alias("score"))


@query(f"with {_MODEL} select topic, i::integer as dim, round(vec[i], 6) as value from {TQ._C}, (select unnest(range(1, 65)) as i)")
def model_centroids(spark, sf_dir):
    c = _reloaded(spark, sf_dir)[1].centroids
    return spark.createDataFrame([(t, i + 1, float(x)) for t, v in enumerate(c) for i, x in enumerate(v)], "topic int, dim int, value double").withColumn("value", F.round("value", 6))


@query(f"with {_MODEL} select topic, place, num from tw where topic = 1 or (topic = 2 and place <= 4)")
def model_topic(spark, sf_dir):
    """All words of one topic, some of another, none of a negative one."""
    model = _trained(spark, sf_dir)[1]
    return model.topic(1).union(model.topic(2, 4)).union(model.topic(-1)).select("topic", "place", "num")


@query(f"with {_MODEL} select topic, place, num from tw where place <= 10")
def model_topics(spark, sf_dir):
    return _trained(spark, sf_dir)[1].topics(10).select("topic", "place", "num")


@query(f"with {_DOCS} select doc_id, topic, round(prob, 6) as prob, place from dt where place <= 3")
def model_top_topics(spark, sf_dir):
    vectors, model = _reloaded(spark, sf_dir)
    return model.top_topics(TQ._freqs(TQ._tokens(spark, sf_dir)), vectors, 3).select("doc_id", "topic", F.round("prob", 6).alias("prob"), "place")


@query(f"with {_DOCS} select d.doc_id, coalesce(topic, -1)::integer as topic from (select distinct doc as doc_id from freq) d left join (select doc_id, topic from dt where place = 1) t using (doc_id)")
def model_transform(spark, sf_dir):
    vectors, model = _trained(spark, sf_dir)
    return model.transform(TQ._freqs(TQ._tokens(spark, sf_dir)), vectors)


@query(f"with {TQ._DVEC}, {TQ._TRAIN}, {TQ._PROB}, {TQ._WORDSQL}, {TQ._refresh_sql(1)}")
def model_update(spark, sf_dir):
    """Topic words from the corpus."""
    vectors, model = _trained(spark, sf_dir)
    return model.update_top_words(TQ._freqs(TQ._tokens(spark, sf_dir)), vectors, 1, 100).words.select("topic", "place", "num", F.round("score", 6).alias("score"))


_MEASURES = f"with {Q.ENTITY_VECTORS}, {Q.TOKENS}, {TQ._TRAIN}, {TQ._WORDSQL}, {TQ._INTREE}"


@query(f"{_MEASURES}, c as (select topic, avg(npmi) as npmi, avg(pmi) as pmi, avg(lc) as lc from sc group by topic) select 'npmi' as measure, round(avg(npmi), 6) as value from c union all select 'pmi', round(avg(pmi), 6) from c union all select 'lc', round(avg(lc), 6) from c")
def model_coherence(spark, sf_dir):
    """The coherence of a model by each measure with base-2 logarithms."""
    model, tokens = _trained(spark, sf_dir)[1], materialise(TQ._tokens(spark, sf_dir))
    return spark.createDataFrame([(m, model.coherence(tokens, m)) for m in ("npmi", "pmi", "lc")], "measure string, value double").withColumn("value", F.round("value", 6))


_SHEET = f"with {TQ._NAMED}"


def _sheet(spark, sf_dir) -> DataFrame:
    w = R.wide(TQ._named(spark, sf_dir), 5, 1e-4)
    cells = [c for i in range(1, 6) for c in (F.concat(F.lit("Q"), f"id_{i}").alias(f"Id {i}"), F.col(f"word_{i}").alias(f"Word {i}"), F.col(f"score_{i}").alias(f"Score {i}"))]
    return w.select(F.col("topic").alias("Topic No."), F.concat(F.lit("topic "), "topic").alias("Topic Label"), *cells)


@query(f"{_SHEET} select topic, place, 'Q' || num as id, label as word, round(score, 6) as score from tl where place <= 5 and score > 1e-4")
def io_sheet(spark, sf_dir):
    """A sheet of topics, written and read."""
    path = scratch(spark)
    files.write_sheet(_sheet(spark, sf_dir), path)
    return files.read_topics_sheet(spark, path).select("topic", "place", "id", "word", F.round("score", 6).alias("score"))


@query(f"{_SHEET} select topic, place, 'Q' || num as id, label as word, round(score, 6) as score from tl where place <= 5 and score > 1e-4")
def io_workbook(spark, sf_dir):
    """The same sheet as a workbook."""
    path = f"{scratch(spark)}/topics.xlsx"
    workbook.write_workbook(_sheet(spark, sf_dir), path)
    return files.read_topics_sheet(spark, path).select("topic", "place", "id", "word", F.round("score", 6).alias("score"))


@query(f"{_SHEET}, s as (select topic, num, place, score from tl where place <= 5 and score > 1e-4) select topic, place, num, round(score / sum(score) over (partition by topic), 6) as score from s")
def model_from_sheet(spark, sf_dir):
    """A model made from a sheet: scores add up to 1 per topic."""
    path = f"{scratch(spark)}/topics.xlsx"
    workbook.write_workbook(_sheet(spark, sf_dir), path)
    model = TopicModel.from_sheet(spark, path, TQ._entity_vectors(spark, sf_dir), TQ.DIMS)
    return model.words.select("topic", "place", "num", F.round("score", 6).alias("score"))


@query(f"with {TQ._CHOSEN} select doc_id, num, count(*) as n from chosen group by all")
def model_matcher(spark, sf_dir):
    """Bags of entities by a matcher that was saved and loaded."""
    path = scratch(spark)
    EntityMatcher(knowledge(spark, sf_dir), TQ._lexicon(spark, sf_dir), TQ._entity_vectors(spark, sf_dir), TQ.DIMS, list(TQ.LANGS), TQ.THRESHOLD).save(path)
    return EntityMatcher.load(spark, path, TQ.DIMS, TQ.THRESHOLD).entitize(table(spark, sf_dir, "documents"))
