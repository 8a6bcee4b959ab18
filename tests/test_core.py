"""Golden cases and properties of functions and operators."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.functions import lemmatizers, similarity, text
from themeloom.functions.ids import entity_number, entity_numbers
from themeloom.operators import bags, coherence, corpus, disambiguate, kb, lexicon, matching, pages, reports, states, topics, vectors


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


# --- ids and states


def test_entity_numbers(spark):
    df = spark.createDataFrame([(" q12 ",), ("Q007",), ("*",), ("",), (None,), ("Q",), ("Q1x",), ("Q99999999999999999999",)], "id string")
    assert [r.n for r in df.select(entity_number("id").alias("n")).collect()] == [12, 7, None, None, None, None, None, None]
    assert one(spark, entity_numbers(F.array(F.lit("Q1"), F.lit("*"), F.lit(" q2"), F.lit(None)))) == [1, 2]


def test_latest_state(spark):
    rows = [("Q1", 3, 5, "a"), ("q1 ", 3, 4, "b"), ("Q1", 2, 1, "c"), ("Q2", None, 9, "d"), ("Q2", 1, 10, "e"), (None, 9, 1, "f"), ("Q1", 3, 4, "b")]
    df = spark.createDataFrame(rows, "id string, at int, n int, key string")
    got = states.latest_state(df, entity_number("id"), "at", "n", {"v": F.col("key")}).collect()
    assert sorted((r.key, r.v) for r in got) == [(1, "b"), (2, "e")]
    assert states.latest_state(df.limit(0), entity_number("id"), "at", "n", {"v": F.col("key")}).count() == 0


# --- functions


def test_similarities(spark):
    a, b = F.array(*[F.lit(x) for x in (1, 2, 3)]), F.array(*[F.lit(x) for x in (2, 3, 4, 5)])
    assert math.isclose(one(spark, similarity.cosine_set(a, b)), 2 / math.sqrt(12))
    assert math.isclose(one(spark, similarity.jaccard(a, b)), 2 / 5) and math.isclose(one(spark, similarity.overlap_coefficient(a, b)), 2 / 3)
    empty = F.array().cast("array<int>")
    assert one(spark, similarity.jaccard(empty, empty)) is None and one(spark, similarity.overlap_coefficient(a, empty)) is None
    x, y = [1.0, 2.0, 4.0], [2.0, 1.0, 7.0]
    c = lambda v: F.array(*[F.lit(q) for q in v])
    assert math.isclose(one(spark, similarity.cosine(c(x), c(y))), float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)))
    assert math.isclose(one(spark, similarity.pearson(c(x), c(y))), float(np.corrcoef(x, y)[0, 1]))
    assert one(spark, similarity.squared_l2(c(x), c(y))) == 11 and one(spark, similarity.dot(c(x), c(y[:2]))) is None and one(spark, similarity.cosine(c(x), c([0.0] * 3))) is None


def test_text_functions(spark):
    lit = lambda s: F.lit(s)
    abc = F.array(lit("a"), lit("b"), lit("c"))
    assert one(spark, text.ngrams(abc, 2)) == [["a", "b"], ["b", "c"]] and one(spark, text.ngrams(abc, 4)) == []
    assert one(spark, text.all_ngrams(abc, 4)) == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"], ["a", "b", "c"]]
    assert one(spark, text.shingles(lit("abcd"), 3)) == ["abc", "bcd"] and one(spark, text.shingles(lit("ab"), 3)) == []
    assert one(spark, text.sliding_windows(abc, 10)) == [["a", "b", "c"]] and len(one(spark, text.sliding_windows(abc, 2))) == 2
    assert one(spark, text.words(lit("  a \n b "))) == ["a", "b"] and one(spark, text.first_words(lit(" a b  c "), 2)) == "a b"
    assert one(spark, text.remove_punctuation(lit("a.b,c-d_e's"))) == "abcdes"
    assert one(spark, text.acronyms(lit("The U.S. of A. but bU. and ÉU."))) == "The US of A but bU. and ÉU."
    assert one(spark, text.title_case(lit("o'neil mcDONALD"))) == "O'Neil Mcdonald" and one(spark, text.first_upper(lit("ab C"))) == "Ab C"
    assert one(spark, text.restore_case(lit("go"), lit("GOING"))) == "GOING" and one(spark, text.restore_case(lit("go"), lit("GOING"), True)) == "GO"
    assert one(spark, text.restore_case(lit("go"), lit("Going"))) == "Go" and one(spark, text.restore_case(lit("go"), lit("going"))) == "go"
    assert one(spark, text.space_apostrophes(lit("l'a’b.c"))) == "l 'a ’b.c" and one(spark, text.space_apostrophes(lit("l'a’b.c"), True)) == "l 'a ’b .c"
    assert [one(spark, text.turkish_suffixes(lit(w))) for w in ("evlerden", "evler", "Evden")] == ["ev", "ev", "Evden"]
    assert one(spark, text.without_parenthesis(lit("A (b) (c)"))) == "A" and one(spark, text.translation_clean(lit("a,b c'd"))) == "a b c"
    assert one(spark, text.remove_prefix(lit("aab"), "a")) == "ab" and one(spark, text.to_text(F.encode(lit("é"), "UTF-8"))) == "é"
    assert one(spark, text.description_of(lit("A"), lit("town"))) == "A, town" and one(spark, text.description_of(lit("A"), lit("A town"))) == "A town" and one(spark, text.description_of(lit("A"), lit(None).cast("string"))) == "A"


@pytest.mark.parametrize(("label", "number"), [("3,5%", True), ("3.5.1", False), ("1_0", True), ("nan", True), ("-Infinity", True), ("12a", False), ("", False), ("5.", True), (".5e3", True), ("%", False)])
def test_numbers(spark, label, number):
    assert one(spark, text.is_number(F.lit(label))) is number


@pytest.mark.parametrize(("label", "valid"), [("A (b)", False), ("x - y", False), ("!abc", False), ("ab", False), ("abc", True), ("4x4", True), ("44x", False), ("", False)])
def test_label_validity(spark, label, valid):
    assert one(spark, text.valid_label(F.lit(label))) is valid


@pytest.mark.parametrize(("key", "is_label", "spaced", "valid"), [("1234", True, False, False), ("NATO", True, False, True), ("UN", True, False, False), ("UNO", True, False, True), ("Iran", True, False, True), ("cat", True, False, False), ("Madonna", False, True, False), ("Jean Paul", False, True, True), ("MADONNA", False, True, False)])
def test_key_validity(spark, key, is_label, spaced, valid):
    assert one(spark, text.valid_key(F.lit(key), F.lit(is_label), F.lit(spaced))) is valid


def test_preprocessors(spark):
    lemmatizers.register("xx", F.upper)
    lemmatizers.register("yy", lemmatizers.from_factory(lambda: lambda batch: [t + "!" for t in batch]))
    df = spark.createDataFrame([("a", "xx"), ("a", "yy"), ("a", "zz"), (None, "yy")], "t string, l string")
    assert [r.v for r in df.select(lemmatizers.preprocess(F.col("t"), F.col("l")).alias("v")).collect()] == ["A", "a!", "a", None]
    with pytest.raises(TypeError):
        lemmatizers.register("xx", 3)
    vec = lemmatizers.encode(spark.createDataFrame([(1, "a b c"), (2, "")], "d bigint, t string"), "d", "t", lambda: lambda ts: [[float(len(t))] for t in ts], 2)
    assert [tuple(r) for r in vec.collect()] == [(1, [3.0])]


# --- bags


def as_bag(spark, d, owner=1):
    return spark.createDataFrame([(owner, k, float(v)) for k, v in d.items()], "owner int, key string, value double")


def values(df):
    return {r.key: r.value for r in df.collect()}


def test_bag_algebra(spark):
    a, b = as_bag(spark, {"a": 1, "b": 2}), as_bag(spark, {"b": 3, "c": 4})
    assert values(bags.combine(a, b, "add")) == {"a": 1, "b": 5, "c": 4} and values(bags.combine(a, b, "mul", True)) == {"b": 6}
    assert values(bags.combine(a, b, "sub")) == {"a": 1, "b": -1, "c": -4} and values(bags.combine(a, b, "pow")) == {"a": 1, "b": 8, "c": 0}
    assert values(bags.combine(a, b, "div")) == {"a": None, "b": 2 / 3, "c": 0} and bags.inner(a, b).first().value == 6
    assert values(bags.frequencies(a)) == {"a": 1 / 3, "b": 2 / 3} and values(bags.frequencies(as_bag(spark, {"a": 1, "b": -1}))) == {"a": 1, "b": -1}
    assert values(bags.scalar(a, "mod", -3)) == {"a": -2, "b": -1} and values(bags.scalar(a, "sub", 5, reflected=True)) == {"a": 4, "b": 3} and values(bags.negate(a)) == {"a": -1, "b": -2}
    assert values(bags.compare(a, "ne", 1)) == {"b": 2} and bags.holds_any(a, "gt", 1).first().holds is True
    assert values(bags.head(a, 1)) == {"b": 2} and values(bags.tail(a, 1)) == {"a": 1} and values(bags.filtered(a, keys=lambda k: k == "a")) == {"a": 1}
    with pytest.raises(Exception, match="missing key"):
        bags.combine(a, b, "div", strict=True).collect()
    counted = bags.bag(spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (1, None)], "o int, k string"), "o", "k")
    assert values(counted) == {"x": 2} and bags.combine(a.limit(0), b.limit(0), "add").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(-9, 9), max_size=5), st.dictionaries(st.sampled_from("abcde"), st.integers(-9, 9), max_size=5))
def test_bag_operations_follow_their_definition(spark, x, y):
    a, b = as_bag(spark, x), as_bag(spark, y)
    for name, f in (("sub", lambda p, q: p - q), ("floordiv", lambda p, q: math.floor(p / q) if q else None), ("mod", lambda p, q: p % q if q else None)):
        assert values(bags.combine(a, b, name)) == {k: f(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}}


# --- matching


@pytest.mark.parametrize(("t", "hits"), [("a cat.", [(2, 5)]), ("concat", []), ("cats sat", [(0, 3)]), ("cats", []), ("catss ", []), ("cat", [(0, 3)]), ("CATS cat", [(5, 8)]), ("cat_s", [(0, 3)])])
def test_word_borders(t, hits):
    assert [(a, b) for a, b, _ in matching.find(t, matching.trie_of(["cat"]))] == hits


def brute_matches(t, keys):
    out = set()
    for k in keys:
        at = t.find(k)
        while at >= 0:
            end = at + len(k)
            left = at == 0 or not t[at - 1].isalnum()
            right = end == len(t) or not t[end].isalnum() or (t[end] in "sS" and end + 1 < len(t) and not t[end + 1].isalnum())
            if left and right:
                out.add((at, end, k))
            at = t.find(k, at + 1)
    return out


def test_matches_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        make = lambda n: "".join(rng.choice("abs S.'é") for _ in range(n))  # noqa: E731, B023
        keys = {k for k in (make(rng.randint(1, 5)).strip() for _ in range(6)) if k and k[0].isalnum() and k[-1].isalnum()}
        t = make(40)
        assert set(matching.find(t, matching.trie_of(sorted(keys)))) == brute_matches(t, keys)


@pytest.mark.parametrize(("spots", "kept"), [([(0, 8), (0, 3), (4, 8)], [(0, 8)]), ([(0, 4), (3, 9)], [(3, 9)]), ([(0, 4), (3, 7)], [(0, 4)]), ([(0, 4), (4, 8)], [(0, 4)]), ([(0, 4), (5, 8)], [(0, 4), (5, 8)])])
def test_overlaps(spark, spots, kept):
    found = [(a, b, "k") for a, b in spots]
    assert [(a, b) for a, b, _ in matching.resolved(found)] == kept
    df = spark.createDataFrame([(1, *m) for m in found], "doc_id bigint, start int, stop int, key string")
    assert sorted((r.start, r.stop) for r in matching.resolve_overlaps(df).collect()) == kept


def test_mentions_held_or_joined_and_mask(spark):
    docs = spark.createDataFrame([(1, "New York and\nYork, the new Yorks.", "en-x"), (2, "york", None), (3, None, "en"), (4, "", "fr"), (5, "Rome Rome", "IT")], "doc_id bigint, text string, lang string")
    lex = spark.createDataFrame([("en", "New York", [1]), ("en", "York", [2, 3]), ("en", "Rome", [4]), ("fr", "Rome", [4])], "lang string, key string, ids array<bigint>")
    want = [(1, 0, 8, "New York"), (1, 13, 17, "York"), (1, 27, 31, "York"), (5, 0, 4, "Rome"), (5, 5, 9, "Rome")]
    for held in (4_000_000, 0):
        got = matching.mentions(docs, "doc_id", "text", "lang", lex, held_bytes=held)
        assert sorted(map(tuple, got.collect())) == want
    masks = {r.doc_id: r.masked for r in matching.masked(docs, "doc_id", "text", got).collect()}
    assert masks[1] == " __match__New_York  and  __match__York , the new  __match__York s." and masks[3] == "" and masks[2] == "york"
    assert matching.mentions(docs.limit(0), "doc_id", "text", "lang", lex).count() == 0 and matching.mentions(docs, "doc_id", "text", "lang", lex.limit(0)).count() == 0


def test_languages_that_do_not_part_words(spark):
    docs = spark.createDataFrame([(1, "กขคกข", "th"), (2, "กขค", "en")], "doc_id bigint, text string, lang string")
    lex = spark.createDataFrame([("th", "ขค", [1]), ("th", "ข", [2]), ("en", "ขค", [1])], "lang string, key string, ids array<bigint>")
    for held in (4_000_000, 0):
        assert sorted(map(tuple, matching.mentions(docs, "doc_id", "text", "lang", lex, held_bytes=held).collect())) == [(1, 1, 3, "ขค"), (1, 4, 5, "ข")]
    text = "abab b"
    assert set(matching.automaton_of(["ab", "b"])(text)) == {(0, 2, "ab"), (2, 4, "ab"), (1, 2, "b"), (3, 4, "b"), (5, 6, "b")} and not list(matching.automaton_of([])(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
def test_resolved_intervals_follow_the_rule(spots):
    found = sorted({(a, a + n, "k") for a, n in spots})
    outer = [x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)]
    gone = {(b if b[1] - b[0] <= a[1] - a[0] else a) for a, b in zip(outer, outer[1:], strict=False) if a[1] >= b[0]}
    assert matching.resolved(found) == [x for x in outer if x not in gone]


# --- knowledge base, lexicon, disambiguation


@pytest.fixture(scope="module")
def small_kb(spark):
    rec = lambda n, i, labels, desc, ali, props, wiki=None: (n, i, labels, desc, ali, props, wiki, n)
    rows = [
        rec(1, "Q10", '{"en": "Paris", "fr": "Paris"}', '{"en": "city"}', '{"en": ["City of Light", "PAR", "abc"]}', '{"instance_of": ["Q5", {"id": "Q6"}]}', "Paris"),
        rec(2, "Q9", '{"en": "Paris"}', '{"en": "person"}', '{"en": ["Paris H", "Parisot"]}', '{"instance_of": ["Q1"]}', "Paris_(person)"),
        rec(3, "Q8", '{"en": "12%"}', '{"en": "number"}', "{}", "{}"),
        rec(4, "Q7", '{"en": "Lyon"}', "{}", "{}", '{"instance_of": "Q5", "part_of": ["Q7", "Q10"]}', "paris"),
        rec(5, "Q10", '{"en": "Paris old"}', '{"en": "city"}', "", "null"),
    ]
    rows[4] = (5, "q10 ", *rows[4][2:7], 0)
    return kb.summarise(spark.createDataFrame(rows, "rec_no bigint, id string, labels string, descriptions string, aliases string, properties string, enwiki string, seen_at bigint"))


def test_knowledge_base(spark, small_kb):
    k = small_kb
    assert {r.num for r in kb.usable(k).collect()} == {9, 10} and {r.label: r.num for r in kb.smallest_by_label(k, "en").collect()} == {"Paris": 9, "12%": 8, "Lyon": 7}
    counts = kb.property_counts(k)
    assert sorted(map(tuple, counts.collect())) == [("instance_of", 1, "Q1", 1), ("instance_of", 5, "Q5", 2), ("instance_of", 6, "Q6", 1)]
    merged = kb.merge_curated(counts, spark.createDataFrame([(5, 1), (5, 0), (1, 0)], "value bigint, relevant int"))
    assert sorted(map(tuple, kb.relevant_values(merged).collect())) == [("instance_of", 5)]
    none = spark.createDataFrame([], "num bigint")
    assert {r.num for r in kb.gated(k, kb.relevant_values(merged), none).collect()} == {7, 10} and {r.num for r in kb.gated(k, kb.relevant_values(merged), spark.createDataFrame([(9,)], "num bigint")).collect()} == {7, 9, 10}
    assert sorted(map(tuple, kb.edges(k).collect())) == [(7, 5), (7, 10), (9, 1), (10, 5), (10, 6)]
    assert {r.title: r.num for r in kb.page_titles(k).collect()} == {"Paris": 10, "Paris (person)": 9, "Paris (Person)": 9, "paris (person)": 9, "paris": 7, "12%": 8, "Lyon": 7}
    assert {r.text for r in kb.to_translate(k, "fr", 1, with_people=False).collect()} == set() and {r.text for r in kb.to_translate(k, "de", 5, with_people=False).collect()} == {"Paris H"}
    named = kb.translated(spark.createDataFrame([(10, "z"), (3, "z")], "num bigint, label string"), "num", k, "fr")
    assert sorted(map(tuple, named.collect())) == [(3, "<NO TRANSLATION>"), (10, "Paris")]
    top = kb.top_ranked(spark.createDataFrame([("Q1", 5), ("q2", 9), (None, 99), ("Q2", 1), ("Q3", 5)], "entity string, qrank bigint"), 2, spark.createDataFrame([(77,)], "num bigint"))
    assert {r.num for r in top.collect()} == {2, 1, 77}


def test_lexicon(spark, small_kb):
    forms = lexicon.surface_forms(small_kb, ["en", "fr"], [1], spark.createDataFrame([("fr", "Lyon", "Lyonne")], "lang string, label string, translation string"))
    lex = lexicon.posting_lists(forms)
    got = {(r.lang, r.key): r.ids for r in lex.collect()}
    assert got["en", "Paris"] == [10] and got["fr", "Paris"] == [10] and got["fr", "Paris H"] == [9] and got["en", "PAR"] == [10]
    assert ("en", "abc") not in got and ("en", "Parisot") not in got and got["fr", "Lyonne"] == [7] and ("fr", "Lyon") not in got
    gone = lexicon.removed(forms, spark.createDataFrame([("all", "paris"), ("en", "LYON")], "lang string, label string"), ["en", "fr"])
    left = {(r.lang, r.key) for r in gone.collect()}
    assert ("en", "Paris") not in left and ("fr", "Paris") not in left and ("en", "Lyon") not in left and ("fr", "Lyonne") in left
    lower = lexicon.surface_forms(small_kb, ["en"], [1], prepare=lambda key, lang: F.lower(key))
    assert {r.key for r in lower.collect()} == {"paris", "city of light", "paris h", "lyon"}
    bare = lexicon.removed(lower, spark.createDataFrame([("en", "LYON")], "lang string, label string"), ["en"], prepare=lambda key, lang: F.lower(key))
    assert {r.key for r in bare.collect()} == {"paris", "city of light", "paris h"}
    fixed = lexicon.patched(lexicon.posting_lists(gone), spark.createDataFrame([("all", "paris", 9), ("fr", "paris", 10), ("en", "x", 999), ("en", None, 9), ("en", "", 9)], "lang string, alias string, num bigint"), small_kb, ["en", "fr"])
    got = {(r.lang, r.key): r.ids for r in fixed.collect()}
    assert got["en", "PARIS"] == [9] and got["fr", "Paris"] == [10] and ("en", "X") not in got


def test_disambiguation(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "num bigint, vec array<double>")
    lex = spark.createDataFrame([("en", "a", [1, 2]), ("en", "b", [3]), ("en", "c", [9])], "lang string, key string, ids array<bigint>")
    found = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 3, "b"), (1, 4, 5, "b"), (1, 6, 7, "c"), (2, 0, 1, "c")], "doc_id bigint, start int, stop int, key string")
    cands = disambiguate.candidates(found, spark.createDataFrame([(1, "en"), (2, "en")], "doc_id bigint, lang string"), lex)
    docs = disambiguate.mean_of_candidates(cands, vecs, 2)
    scores = disambiguate.scored(cands, docs, vecs, 0.5)
    picked = disambiguate.chosen(cands, scores)
    assert sorted(map(tuple, picked.collect())) == [(1, 0, 1), (1, 2, 3), (1, 4, 3)]
    assert sorted(map(tuple, disambiguate.bags(picked, 3).collect())) == [(1, 1, 1), (1, 3, 2)] and disambiguate.bags(picked, 4).count() == 0
    more = disambiguate.extended(picked, spark.createDataFrame([(1, "p", 0, 3), (1, "q", 0, 3), (3, "p", 0, 2), (3, "p", 1, 8)], "num bigint, property string, pos bigint, value bigint"), docs, vecs, 0.9)
    assert Counter(r.num for r in more.collect()) == {1: 1, 3: 3}


# --- vectors, topics, coherence


def test_two_part_vectors_and_means(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "num bigint, vec array<double>")
    got = vectors.bimodal(a, a.where("num = 1"), 1.0).collect()
    assert len(got) == 1 and np.allclose(got[0].vec, np.array([1, 0, 1, 0]) * math.sqrt(0.5))
    with pytest.raises(ValueError):
        vectors.bimodal(a, a, 0)
    assert [r.num for r in vectors.missing(spark.createDataFrame([(1,), (5,)], "num bigint"), a).collect()] == [5]
    bad = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [1.0]), (6, [None, 1.0])], "num bigint, v array<double>")
    assert [(r.num, r.vec) for r in vectors.usable(bad, "num", "v", 2).collect()] == [(1, [0.6, 0.8])]
    with pytest.raises(ValueError):
        vectors.gram(a, "num", "vec", 1)
    assert {(r.a, r.b): r.cosine for r in vectors.gram(a, "num", "vec").collect()} == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 1}


def test_inference_probabilities(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "doc_id bigint, vec array<double>")
    got = {(r.doc_id, r.topic): (r.prob, r.place) for r in topics.document_topics(docs, np.array([[1.0, 0.0], [0.0, 2.0]])).collect()}
    assert np.isclose(got[1, 0][0], 16 / 17) and np.isclose(got[1, 1][0], 1 / 17) and got[2, 0] == (1.0, 1) and got[2, 1][0] == 0
    best = topics.best_topic(spark.createDataFrame([(1,), (7,)], "doc_id bigint"), topics.document_topics(docs, np.array([[1.0, 0.0], [0.0, 2.0]])))
    assert sorted(map(tuple, best.collect())) == [(1, 0), (7, -1)]


def test_lloyd_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "num bigint, vec array<double>")
    got = topics.lloyd(df, topics.start_vectors(df, 4), 5)
    c = x[:4].copy()
    for _ in range(5):
        label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[label == k].mean(axis=0) for k in range(4)])
    assert np.allclose(got, c)
    words = topics.topic_words(df, got, 300).collect()
    assert len(words) == 800 and np.isclose(sum(r.score for r in words), 4)
    assert {r.place for r in topics.usable_topics(topics.topic_words(df, got, 3), 0.2, 2).collect()} <= {1, 2, 3}


def test_coherence_golden(spark):
    docs = [[1, 2, 3], [1, 2], [3, 1], [4]]
    tokens = spark.createDataFrame([(d, p + 1, t) for d, ts in enumerate(docs) for p, t in enumerate(ts)], "doc bigint, pos int, tok bigint")
    words = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 2, 0.5), (1, 1, 1, 0.6), (1, 2, 4, 0.4)], "topic int, place int, num bigint, score double")
    assert coherence.diversity(words).first().diversity == 0.75
    got = {r.topic: r for r in coherence.pair_scores(tokens, words).collect()}
    n = 8
    assert np.isclose(got[0].pmi, math.log2((2 / n) / (3 / n * 2 / n))) and np.isclose(got[0].npmi, got[0].pmi / -math.log2(2 / n)) and np.isclose(got[0].lc, math.log2(2 / 2))
    assert np.isclose(got[1].pmi, math.log2((1 / n) / (3 / n * 1 / n)))  # never together: counts once
    um = {r.topic: r.u_mass for r in coherence.umass(tokens, words).collect()}
    assert np.isclose(um[0], math.log((2 / 4 + 1e-12) / (3 / 4)))
    units = {(tuple(r.unit), r.tok) for r in coherence.windows(tokens, 2).collect()}
    assert {u for u, _ in units if u[0] == 0} == {(0, 1), (0, 2)} and ((0, 2), 1) not in units
    assert coherence.window_coherence(tokens, words, 10, 2).count() == 2
    assert -1 <= got[0].npmi <= 1
    with pytest.raises(ValueError):
        coherence.topic_coherence(coherence.pair_scores(tokens, words), "x")


# --- corpora, pages, reports


def test_corpus(spark):
    c = spark.createDataFrame([(i * 3, f"t{i}") for i in range(10)], "n bigint, title string")
    c = corpus.renumbered(c, F.col("n"))
    assert [r.pos for r in c.orderBy("n").collect()] == list(range(10))
    a, b = corpus.split(c, 0.0, 1)
    assert a.count() == 1 and b.count() == 9 and corpus.split(c, 1.0, 1)[1].count() == 1
    order = [r.title for r in corpus.shuffled(c, 5).orderBy("pos").collect()]
    assert sorted(order) == [f"t{i}" for i in range(10)] and order != sorted(order) and order == [r.title for r in corpus.shuffled(c, 5).orderBy("pos").collect()]
    both = corpus.concatenated(c, c.drop("n"))
    assert sorted(r.pos for r in both.collect()) == list(range(20)) and corpus.concatenated(c.limit(0), c).count() == 10
    kept = corpus.filtered(c, "n", lambda n: n > 20).orderBy("pos").collect()
    assert [(r.pos, r.n) for r in kept] == [(0, 21), (1, 24), (2, 27)]
    with pytest.raises(Exception, match="same positions"):
        corpus.add_column(c, c.select("pos", F.lit(1).alias("value")).where("pos > 0"), "x").collect()
    assert [r.chunk for r in corpus.chunks(c, 4).orderBy("pos").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert one(spark, corpus.or_empty(F.array().cast("array<string>"))) == ["<EMPTY>"]


def test_pages(spark):
    html = '<p>a <span>x</span><a href="/wiki/New_York_(city)#top">b</a> &amp; [12] [3, 4]</p>\n<p>c</p><a href="/wiki/File:z">f</a><a class="q" href="/wiki/Old">o</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_no bigint, page string")
    assert df.select(pages.paragraphs(F.col("page")).alias("t")).first().t == "a b &  \nc"
    got = pages.anchors(df, "page_no", "page", spark.createDataFrame([("New York", 60)], "title string, num bigint"))
    assert [tuple(r) for r in got.collect()] == [(1, 0, 60)]
    counts = spark.createDataFrame([(1, 5, 1), (1, 6, 3), (2, 6, 2)], "page_no bigint, num bigint, n bigint")
    own = spark.createDataFrame([(1, 5), (2, 7), (3, 8)], "page_no bigint, num bigint")
    assert sorted(map(tuple, pages.boosted(counts, own).collect())) == [(1, 5, 4), (1, 6, 3), (2, 6, 2), (2, 7, 3), (3, 8, 1)]


def test_reports(spark):
    t = spark.createDataFrame([(0, 1, 10, "Aé", 0.75), (0, 2, 11, 'B "x"', 0.25)], "topic int, place int, num bigint, label string, score double")
    w = reports.wide(t, 2, 0.3).first()
    assert (w.id_1, w.word_1, w.score_1, w.id_2) == (10, "Aé", 0.75, None)
    assert reports.as_json(t).first().json == '{"FeatureWords":["Aé","B \\"x\\""],"TopicID":"000000"}'
    assert reports.as_markdown(t, 1).first().line == "| 0 | Aé (0.750) |" and reports.upper_words(t, 1).first().word == "AÉ"
    assert tuple(reports.matrix(t, [11, 12]).first()) == (0, 0.25, 0.0)
    d = spark.createDataFrame([(7, 3, 0.9, 1), (7, 1, 0.1, 2)], "doc_id bigint, topic int, prob double, place int")
    assert tuple(reports.document_report(d, 2).first()) == (7, "3 (0.900)", "1 (0.100)")


def test_a_large_lexicon_is_joined_with_the_same_result(spark, sf):
    """Keys of many lengths over real texts, all matches and those that remain, by trie and by join."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    words = sorted({w for r in rows for w in re.findall(r"[^\W_]+", r.text or "")})[::7]
    pairs_ = sorted({m for r in rows for m in re.findall(r"[^\W_]+ [^\W_]+|[^\W_]+[-'] ?[^\W_]+", r.text or "")})[::5]
    lex = spark.createDataFrame([(c, k) for c in ("en", "de") for k in {*words, *pairs_, *(w[:-1] for w in words if w.endswith("s") and len(w) > 1)}], "lang string, key string")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for overlaps in (True, False):
        one, other = (sorted(map(tuple, matching.mentions(docs, "doc_id", "text", "lang", lex, overlaps=overlaps, held_bytes=held).distinct().collect())) for held in (4_000_000, 0))
        assert one == other and len(one) > 500


def test_preprocessing_around_a_morphology(spark):
    from themeloom.functions import lemmatizers as L

    rows = [("Evlerden U.S. GELDİ Ankara'dan",), ("kitaplardan Ali",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    known = F.create_map(F.lit("Evlerden"), F.array(F.lit("ev"), F.lit("evler")), F.lit("kitaplardan"), F.array(F.lit("kitap"), F.lit("kitaplardan")))
    of = lambda w: F.coalesce(F.try_element_at(known, w), F.array(w))
    assert [r[0] for r in df.select(L.lemmatizer("tr", of)(F.col("t"))).collect()] == ["Evler US GELDİ Ankara '", "kitap Ali", None, ""]
    assert [r[0] for r in df.select(L.lemmatizer("ru")(F.col("t"))).collect()][1] == "kitaplardan Ali"
    assert df.select(L.lemmatizer("en", lambda w: F.array(F.lit("be")))(F.col("t")).alias("x")).collect()[1].x == "be Be"
    tags = L.tagged(spark.createDataFrame([(1, "a bc"), (2, None), (3, "")], "d bigint, t string"), "d", "t", lambda: lambda texts: [[(m.start(), m.end(), "X") for m in re.finditer(r"\w+", t)] for t in texts])
    assert sorted(map(tuple, tags.collect())) == [(1, 0, 1, "X"), (1, 2, 4, "X")]


def test_numbered_and_aligned_files(spark, tmp_path):
    from themeloom.sources import files

    df = spark.createDataFrame([(i, f"text {i}\nmore" if i % 3 else None, [f"Q{i}", "Q1"] if i % 2 else []) for i in range(50)], "i int, t string, e array<string>").repartition(5)
    files.write_aligned(df, "t", "e", str(tmp_path / "a"))
    back = files.read_aligned(spark, str(tmp_path / "a")).collect()
    assert sorted(r.line for r in back) == list(range(50))
    assert sorted((r.text, tuple(r.entities)) for r in back) == sorted((f"text {i} more" if i % 3 else "", (f"Q{i}", "Q1") if i % 2 else ()) for i in range(50))
    lines = [x for f in sorted((tmp_path / "a" / "text").glob("part-*")) for x in f.read_text().splitlines()]
    assert [r.value for r in files.numbered_lines(spark, str(tmp_path / "a" / "text")).orderBy("line").collect()] == lines


def test_walks_follow_edges_and_neighbours_are_near(spark):
    from themeloom.operators import walks

    rng = random.Random(3)
    rows = [(a, b) for half in (0, 50) for a in range(half, half + 50) for b in rng.sample(range(half, half + 50), 5)] + [(1, 1), (None, 2), (3, None), (7, 200), (200, 200), (5, 6), (5, 6)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint")
    good = {(a, b) for a, b in rows if a is not None and b is not None and a != b}
    got = walks.random_walks(df, "src", "dst", 8, per_node=3).collect()
    assert sorted((r.start, r.walk) for r in got) == sorted((n, k) for n in [*range(100), 200] for k in range(3))
    assert all(r.path[0] == r.start and set(zip(r.path, r.path[1:], strict=False)) <= good and (len(r.path) == 8 or r.path[-1] == 200) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, walks.random_walks(df, "src", "dst", 8, per_node=3).collect()))
    for salts in (1, 4):
        near = walks.neighbours(df, "src", "dst", salts).collect()
        assert {(r.node, r.next) for r in near} == good and all({r.i for r in near if r.node == n} == set(range(sum(a == n for a, _ in good))) for n in (1, 5, 7))
    v = {r.num: np.array(r.vec) for r in walks.walk_vectors(walks.random_walks(df, "src", "dst", 20, per_node=20), 8, iterations=3).collect()}
    cos = lambda a, b: float(v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])))
    same, other = np.mean([cos(a, b) for a in range(50) for b in range(a)]), np.mean([cos(a, b) for a in range(50) for b in range(50, 100)])
    assert same > other + 0.2
    with pytest.raises(ValueError):
        walks.walk_vectors(walks.random_walks(df, "src", "dst", 2), 8, most_bytes=100)
    assert walks.walk_vectors(walks.random_walks(df.limit(0), "src", "dst", 3), 8).count() == 0
