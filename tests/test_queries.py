"""Every core query against its oracle SQL, over whole tables at the smallest scale; layout of the package."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connection, oracle_rows, rows_of

import __spark_entry__
from themeloom.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, con, name):
    assert rows_of(QUERIES[name](spark, sf)) == oracle_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_no_event_text_or_word_is_left_out(spark, sf, con, tmp_path):
    import hashlib

    import pandas as pd

    counted = {"bag_add": "select (select count(*) from events where user_id is not null and ts is not null) + (select count(*) from orders where o_custkey is not null and o_orderdate is not null)", "bag_compare": "select count(*) from events where user_id is not null and event_type is not null"}
    for name, sql in counted.items():
        rows = QUERIES[name](spark, sf)
        rows = rows.where("kind in ('ne', 'eq')") if "kind" in rows.columns else rows
        assert rows.agg({"value": "sum"}).first()[0] == con.execute(sql).fetchone()[0]
    texts = ["In the U.S.A. and the U.S. of A. but bU. and ÉU.", "Die Größe der STRAßE, GROSS und ßa", "Maß U.K.", ""]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    want = {i: hashlib.md5(re.sub(r"(?<!\w)([A-Z])\.", r"\1", t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.digest for r in QUERIES["acronym"](spark, str(tmp_path)).collect()} == want
    words = {w for t in texts for w in re.findall(r"[^\W\d_]+", t)}
    restored = {w: w if w.isupper() else w[:3].title() if w.istitle() else w[:3].lower() for w in words}
    assert {r.word: r.lemma for r in QUERIES["title_case_restore"](spark, str(tmp_path)).collect()} == restored


def test_every_document_gives_its_grams(spark, sf, con):
    import collections

    texts = [t or "" for (t,) in con.execute("select text from documents").fetchall()]
    lists = [[w for w in re.split("[ \t\r\n\f\v]+", t) if w] for t in texts]
    want = {
        "ngrams_documents": collections.Counter(" ".join(w[i : i + 2]) for w in lists for i in range(len(w) - 1)),
        "allngrams_documents": collections.Counter(" ".join(w[i : i + k]) for w in lists for k in (1, 2, 3) for i in range(len(w) - k + 1)),
        "kshingles_documents": collections.Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4)),
    }
    for name, counts in want.items():
        assert {r[0]: r.n for r in QUERIES[name](spark, sf).collect()} == dict(counts), name
    assert QUERIES["sliding_windows_documents"](spark, sf).count() == sum(max(1, len(w) - 9) for w in lists)


def test_topics_are_trained_to_the_end(spark, sf):
    import numpy as np

    from themeloom.operators import topics
    from themeloom.plans import topic_queries

    vectors = topic_queries._entity_vectors(spark, sf).collect()
    x = np.array([r.vec for r in vectors], float)
    c = np.array([r.vec for r in QUERIES["kmeans_lloyd_full"](spark, sf).orderBy("topic").collect()])
    assert len(c) == min(100, len(x))
    label = topics.squared_distances(x, c).argmin(axis=1)
    assert all(np.allclose(c[k], x[label == k].mean(axis=0), atol=1e-9) for k in set(label.tolist()))  # one more round moves nothing


def test_full_queries_stand_on_the_full_topics(spark, sf):
    import numpy as np

    from themeloom.plans import topic_queries

    c = np.array([r.vec for r in QUERIES["kmeans_lloyd_full"](spark, sf).orderBy("topic").collect()])
    vectors = topic_queries._entity_vectors(spark, sf)
    docs = {r.doc_id: np.array(r.vec) for r in topic_queries._doc_vectors(topic_queries._freqs(topic_queries._tokens(spark, sf)), vectors).collect()}
    got = {r.doc_id: r.topic for r in QUERIES["doc_top_topic_full"](spark, sf).collect()}
    assert set(docs) <= set(got) and all(((docs[d] - c[t]) ** 2).sum() <= ((docs[d] - c) ** 2).sum(axis=1).min() + 1e-9 if d in docs else t == -1 for d, t in got.items())
    assert len(c) > topic_queries.TOPICS and QUERIES["topics_json_full"](spark, sf).count() == len(c)
    assert QUERIES["topics_json"](spark, sf).count() == topic_queries.TOPICS  # nothing stays set


def test_lda_knows_every_entity(spark, sf, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    from themeloom.plans import topic_queries

    seen = []
    fit = CountVectorizer.fit
    monkeypatch.setattr(CountVectorizer, "fit", lambda self, df: seen.append(fit(self, df)) or seen[0])
    monkeypatch.setattr(topic_queries, "REFERENCE_SWEEPS", 1)
    QUERIES["lda_baseline"](spark, sf)
    assert set(seen[0].vocabulary) == {str(r.tok) for r in topic_queries._tokens(spark, sf).select("tok").distinct().collect()}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "topic", "prob", "place", "words"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_core_never_imports_the_subpackage():
    for file in (ROOT / "themeloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s[^\n]*\bllm\b", file.read_text(), re.M), file
    assert "localCheckpoint" not in "".join(f.read_text() for f in (ROOT / "themeloom").rglob("*.py"))


def test_every_query_takes_empty_tables(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    for file in Path(sf).glob("*.parquet"):
        pq.write_table(pq.read_table(file).slice(0, 0), tmp_path / file.name)
    for name in ("lexicon_patch_remove", "entity_mentions", "disambiguate_extend", "kmeans_lloyd", "kmeans_ml", "lda_baseline", "topics_wide", "model_statistics", "corpus_report", "corpus_split", "corpus_filter_concat", "page_text_entities", "p1_found", "p1_nodes", "p7_paths", "p7_cycles", "io_json_value", "io_ranked", "io_aligned", "io_workbook", "model_top_topics", "model_from_sheet", "model_matcher", "weights_matrix", "lemmatized"):
        assert QUERIES[name](spark, str(tmp_path)).count() <= 1, name
