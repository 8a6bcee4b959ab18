"""Round trips of sources and sinks, the topic model and matcher objects, streams."""

import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.model import EntityMatcher, TopicModel
from themeloom.operators import kb as K
from themeloom.sources import dump, files
from themeloom.streaming import entity_stream


def lines(df):
    return sorted(r[0] for r in df.collect())


def test_lines_csv_json(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("a",), ("é",)], "value string")
    files.write_lines(df, p("t"))
    files.write_lines(df, p("t"), append=True)
    assert lines(files.read_lines(spark, p("t"))) == ["a", "a", "é", "é"]
    (tmp_path / "c.csv").write_bytes('x, "Washington, D.C.", \xe9\n"say ""hi""",b\n'.encode("latin-1"))
    assert [tuple(r) for r in files.read_csv(spark, p("c.csv"), "a string, b string, c string").collect()] == [("x", "Washington, D.C.", "é"), ('say "hi"', "b", None)]
    (tmp_path / "h.csv").write_text("alias,id,reason\nİz,Q1,r\nb,Q2\n")
    assert [tuple(r) for r in files.read_config_csv(spark, p("h.csv"), "alias string, id string, reason string").collect()] == [("İz", "Q1", "r"), ("b", "Q2", None)]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, p("j.jsonl"), "a int").collect()) == [1, 3]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, p("j.jsonl"), "a int", strict=True).collect()
    files.write_json(spark.createDataFrame([(1,)], "a int"), p("o"))
    assert files.read_json(spark, p("o"), "a int").first().a == 1
    files.map_file(spark, p("t"), p("m"), lambda c: F.when(c != "a", F.upper(c)))
    assert lines(files.read_lines(spark, p("m"))) == ["É", "É"]
    calls = []
    make = lambda: calls.append(1) or df
    assert files.cached(spark, p("k"), make).count() == files.cached(spark, p("k"), make).count() == 2 and calls == [1]


def test_embeddings_edges(spark, tmp_path):
    v = spark.createDataFrame([("Q1", [0.5, -0.25]), ("Q2", [1e-9, 3.0])], "id string, vec array<double>")
    files.write_embeddings(v, str(tmp_path / "e"), 2)
    assert sorted((r.id, r.vec) for r in files.read_embeddings(spark, str(tmp_path / "e")).collect()) == [("Q1", [0.5, -0.25]), ("Q2", [0.0, 3.0])]
    assert "Q1 0.50000000 -0.25000000" in lines(files.read_lines(spark, str(tmp_path / "e/part=1")))
    e = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    files.write_edges(e, str(tmp_path / "g"))
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "g")).collect()] == [("1", "2")]


def test_dump(spark, tmp_path):
    claim = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    row = {"id": "Q1", "labels": {"en": {"value": "A"}, "xx": {"value": "B"}}, "descriptions": {"en": {"value": "d"}}, "aliases": {"en": [{"value": "a"}, {"value": "b"}]}, "claims": {"P31": [claim({"id": "Q5"}), claim({"time": "+1"}), claim("text"), {}], "P999": [claim({"id": "Q6"})]}, "sitelinks": {"enwiki": {"title": "A"}}}
    bare = {"id": "Q2", "labels": {"xx": {"value": "B"}}}
    (tmp_path / "d.bz2").write_bytes(bz2.compress(("[\n" + json.dumps(row) + ",\n{broken,\n" + json.dumps(bare) + ",\n" + json.dumps({"id": "Q3", "labels": {"fr": {"value": "C"}}}) + "\n]\n").encode()))
    got = {r.id: r for r in dump.summarise_dump(files.read_dump(spark, str(tmp_path / "d.bz2"))).collect()}
    assert got.keys() == {"Q1", "Q3"} and got["Q1"].labels == {"en": "A"} and got["Q1"].aliases == {"en": ["a", "b"]} and got["Q1"].properties == {"instance_of": ["Q5"]} and got["Q1"].enwiki == "A"
    assert got["Q3"].descriptions == {} and got["Q3"].properties == {} and got["Q3"].enwiki is None and len(dump.PROPERTIES) == 96


@pytest.fixture(scope="module")
def world(spark):
    rec = lambda n, name: (n, f"Q{n}", json.dumps({"en": name}), '{"en": "d"}', "{}", "{}", None, n)
    rows = [rec(1, "Alpha Town"), rec(2, "Beta Town"), rec(3, "Gamma Lake"), rec(4, "Delta Lake")]
    kb = K.summarise(spark.createDataFrame(rows, "rec_no bigint, id string, labels string, descriptions string, aliases string, properties string, enwiki string, seen_at bigint"))
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9])], "num bigint, vec array<double>")
    docs = spark.createDataFrame([(1, "Alpha Town and Beta Town", "en"), (2, "Gamma Lake, Delta Lake.", "de"), (3, "nothing", None), (4, None, None)], "doc_id bigint, text string, lang string")
    return kb, vecs, docs


def test_matcher_and_model(spark, world, tmp_path):
    kb, vecs, docs = world
    m = EntityMatcher.fit(kb, vecs, 2, ["de"], [])
    m.save(str(tmp_path / "m"))
    m = EntityMatcher.load(spark, str(tmp_path / "m"), 2)
    bags = m.entitize(docs)
    assert sorted(map(tuple, bags.collect())) == [(1, 1, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1)]
    assert {r.key: r.ids for r in m.entities_of(spark.createDataFrame([("en", "Alpha Town"), ("en", "x")], "lang string, key string")).collect()} == {"Alpha Town": [1], "x": []}
    t = TopicModel.train(vecs, 2, 5, seed=3)
    town = t.predict(spark, [1, 2, 2], vecs)
    best = next(iter(town))
    assert np.isclose(sum(town.values()), 1) and {r.doc_id: r.topic for r in t.transform(docs.select("doc_id").join(bags, "doc_id", "left"), vecs).collect()} == {1: best, 2: 1 - best, 3: -1, 4: -1}
    assert {r.num for r in t.update_top_words(bags, vecs).topic(best, 2).collect()} == {1, 2} and t.topic(-1).count() == 0 and t.num_topics == 2 and t.label(0) == "0"
    tokens = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)], "doc bigint, pos int, tok bigint")
    assert all(isinstance(t.coherence(tokens, c), float) for c in ("npmi", "pmi", "lc", "c_npmi", "c_uci", "u_mass")) and t.diversity() == 0.5
    assert t.to_dataframe(kb, 2).count() == t.to_json(kb).count() == t.to_markdown(kb).count() == 2 and t.statistics(tokens).count() == 1
    t.save(str(tmp_path / "t"))
    again = TopicModel.load(spark, str(tmp_path / "t"))
    assert np.allclose(again.centroids, t.centroids) and again.words.count() == t.words.count()
    for f in (t.fit, t.perplexity):
        with pytest.raises(NotImplementedError):
            f()
    with pytest.raises(ValueError):
        TopicModel.train(vecs, 9)


def test_model_from_sheet(spark, world, tmp_path):
    (tmp_path / "s.csv").write_text('topic no.,label,keep,id 1,word 1,score 1,id 2,word 2,score 2\n1,Towns,TRUE,Q1,Alpha,0.5,Q2,Beta,0.25\n2,Lakes,true,Q3,Gamma,0.5,Q4,Delta,0.00001\n3,No,,Q1,Alpha,1,,,\n,X,true,Q1,Alpha,1,,,\n')
    t = TopicModel.from_sheet(spark, str(tmp_path / "s.csv"), world[1], 2)
    assert t.labels == {0: "Towns", 1: "Lakes"} and np.allclose(t.centroids[1], [0, 1]) and {(r.topic, r.num): round(r.score, 6) for r in t.words.collect()} == {(0, 1): 0.666667, (0, 2): 0.333333, (1, 3): 1.0}


def test_streams(spark, world, tmp_path):
    kb, vecs, docs = world
    m = EntityMatcher.fit(kb, vecs, 2, ["en"], [])
    docs.withColumn("at", F.timestamp_seconds(F.col("doc_id") * 10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string, lang string, at timestamp").parquet(str(tmp_path / "in"))
    q = entity_stream.each_batch(stream, lambda b: m.entitize(b), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    found = entity_stream.mention_stream(stream, "doc_id", "text", "lang", m.lexicon).withColumn("at", F.timestamp_seconds(F.col("doc_id") * 10))
    q = entity_stream.windowed_counts(found, "at").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key: r.n for r in spark.table("counts").collect()} == {"Alpha Town": 1, "Beta Town": 1, "Gamma Lake": 1, "Delta Lake": 1}


def test_workbooks_come_back(spark, tmp_path, monkeypatch):
    import zipfile

    from themeloom.sources import workbook

    df = spark.createDataFrame([(1, "a <b> & \"c\" \x01é", 0.5, True), (2, None, None, False), (3, " two\nlines ", 1e-12, None)], "`No.` int, text string, x double, ok boolean")
    path = str(tmp_path / "r.xlsx")
    workbook.write_workbook(df, path, "A & B")
    back = workbook.read_workbook(spark, path)
    assert back.columns == df.columns
    assert [tuple(r) for r in back.orderBy("`No.`").collect()] == [("1", "a <b> & \"c\" é", "0.5", "true"), ("2", None, None, "false"), ("3", " two\nlines ", "1e-12", None)]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(tmp_path / "s.xlsx", "w") as new:  # as other programs write it: shared texts, a gap
        for name in old.namelist():
            new.writestr(name, old.read(name) if "sheet1" not in name else f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
        new.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>")
    assert [r.asDict() for r in workbook.read_workbook(spark, str(tmp_path / "s.xlsx")).collect()] == [{"a": None, "column 2": None, "bc": "2"}]
    monkeypatch.setattr(workbook, "MOST_ROWS", 2)
    with pytest.raises(ValueError):
        workbook.write_workbook(df, path)
    assert [workbook.column_number(workbook.column_name(i) + "7") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
