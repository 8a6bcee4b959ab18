"""Nested records and hierarchies against brute force, and their defined edge cases."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from themeloom.operators import hierarchy as H
from themeloom.operators import nested as N
from themeloom.plans import knowledge as K


def texts(value):
    """The text under a key value or id at any depth of an object, by recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, str) and k in ("value", "id"):
                yield v
            else:
                yield from texts(v)


def brute_items(rows):
    for rec, field, text in rows:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(doc, dict):
            continue
        for key, value in doc.items():
            for pos, e in enumerate(value if isinstance(value, list) else [value]):
                for t in [e] if isinstance(e, str) else texts(e):
                    if t.strip():
                        yield rec, field, key, pos, t.strip()


def test_items_equal_brute_force(spark, sf):
    d = pd.read_parquet(f"{sf}/wikidata_summary.parquet")
    want = sorted(brute_items((r.rec_no, f, getattr(r, f)) for r in d.itertuples() for f in ("labels", "aliases", "properties")))
    got = sorted(map(tuple, K.p1_found(spark, sf).collect()))
    assert got == want and got


def test_nodes_keep_their_links(spark):
    rows = [(1, '{"a": [{"value": " x "}, null, "", "y"], "b": {"id": "z", "t": [1, true]}}', 5), (1, '{"a": "x"}', 6), (2, "", 7), (3, None, 8), (4, '{"a": ', 9), (5, "[1]", 1), (None, '{"a": ["v"]}', 2), (6, '{"a": [["in list"]]} x', 2), (7, '{"a": [["in list"], NaN]}', 2), (8, "{" + '"a": {' * 200000, 1), (9, '{"a": [["in list"]]}', 1)]
    df = spark.createDataFrame(rows, "rec bigint, field string, label int")  # columns that clash with the operator's own
    nodes = N.shred(df, "rec", ["field"])
    links = N.with_parents(nodes).where("rec = 1 and size(parent) > 0")
    assert links.join(nodes.select("rec", F.col("label").alias("parent")), ["rec", "parent"], "left_anti").count() == 0
    assert sorted(map(tuple, N.items(nodes).select("rec", "item_key", "item_pos", "item").collect()), key=str) == sorted([(1, "a", 0, "x"), (1, "a", 3, "y"), (1, "b", 0, "z"), (1, "a", 0, "x"), (None, "a", 0, "v")], key=str)
    flat = N.table_of(nodes, "field", "*[].t[]").orderBy("pos").collect()
    assert [(r.item_key, r.pos, r.text) for r in flat] == [("b", 0, "1"), ("b", 1, "true")]
    assert {r.schema_path for r in N.schema_paths(nodes).collect()} == {"*", "*[]", "*[].value", "*[].id", "*[].t", "*[].t[]", "*[][]"}


def test_nested_empty_table(spark):
    assert N.items(N.shred(spark.createDataFrame([], "r bigint, j string"), "r", ["j"])).count() == 0


def brute_forest(parent):
    out = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is None:
            out[n] = ("tree", seen[-1], len(seen) - 1, seen[::-1])
        else:
            out[n] = ("on_cycle" if x == n else "below_cycle", 0, -1, None)
    return out


def forest_of(df):
    return {r.node: (r.kind, r.root, r.depth, r.path) for r in df.collect()}


def test_forest_equals_brute_force_in_both_ways(spark):
    rng = random.Random(1)
    rows, parent = [], {}
    for n in range(1, 400):
        p = rng.choice([None, rng.randint(1, 500), rng.randint(1, 40), n if rng.random() < 0.05 else rng.randint(1, 399)])
        parent[n] = p
        rows += [(n, p, "x")] * rng.choice([1, 1, 2])
    for p in {p for p in parent.values() if p is not None} - set(parent):
        parent[p] = None
    df = spark.createDataFrame([*rows, (None, 3, "x")], "child bigint, up bigint, node string")
    want = brute_forest(parent)
    for bound in (200_000, 5):
        got = H.hierarchy(df, "child", "up", task_nodes=bound)
        assert forest_of(got) == want
        assert {n: w[:3] for n, w in forest_of(H.hierarchy(df, "child", "up", task_nodes=bound, paths=False)).items()} == {n: w[:3] for n, w in want.items()}
        below = {}
        for n, (_, _, _, path) in want.items():
            for a in (path or [])[:-1]:
                below[a] = below.get(a, 0) + 1
        assert {r.node: r.n_descendants for r in got.where("kind = 'tree'").collect()} == {n: below.get(n, 0) for n, w in want.items() if w[0] == "tree"}


def test_every_column_is_the_same_in_both_ways(spark):
    """Cycles of several lengths with trees below them, deep chains, several parents, two hierarchies over the same numbers, and the largest numbers there are."""
    rng = random.Random(5)
    big = 2**63 - 1
    rows = [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 4, 2), ("a", 5, 4), ("b", 1, 2), ("b", 1, 3), ("b", 3, 9), ("b", 7, 7), ("a", big, big - 1), ("a", big - 1, big - 2), ("b", big, None), (None, 8, 9)]
    rows += [("a", n, n + 1) for n in range(100, 160)] + [("b", n, rng.randint(1000, n - 1)) for n in range(1001, 1100)]
    df = spark.createDataFrame(rows, "g string, child bigint, up bigint")
    for paths in (True, False):
        one, other = ({tuple(map(str, r)) for r in H.hierarchy(df, "child", "up", task_nodes=bound, paths=paths, within="g").collect()} for bound in (200_000, 1))
        assert one == other and len(one) > 160
    got = {(r.g, r.node): r for r in H.hierarchy(df, "child", "up", task_nodes=1, within="g").collect()}
    assert {n for (g, n), r in got.items() if r.back_edge} == {1, 7}
    assert got["b", 3].kind == "tree" and got["b", 1].n_parents == 2 and got["b", 1].path == [2, 1] and got["b", 3].path == [9, 3]
    assert got["a", big].path == [big - 2, big - 1, big] and got["a", big - 2].n_descendants == 2 and got["a", 160].n_descendants == 60 and got["b", 1000].n_descendants == 99


def test_p7_takes_the_largest_id(spark, tmp_path):
    big = f"Q{2**63 - 1}"
    d = pd.DataFrame({"rec_no": [1, 2], "id": [big, "Q5"], "labels": "{}", "descriptions": "{}", "aliases": "{}", "properties": ['{"subclass_of": ["Q5"]}', '{"located_in": ["' + big + '"]}'], "enwiki": None, "seen_at": pd.Timestamp("2020-01-01"), "loaded_at": pd.Timestamp("2020-01-01")})
    d.to_parquet(tmp_path / "wikidata_summary.parquet")
    assert {tuple(r) for r in K.p7_found(spark, str(tmp_path)).collect()} == {("subclass_of", 2**63 - 1, "tree", 5, 1), ("subclass_of", 5, "tree", 5, 0), ("located_in", 5, "tree", 2**63 - 1, 1), ("located_in", 2**63 - 1, "tree", 2**63 - 1, 0)}


def test_forest_known_parents_only_and_empty(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (5, 4)], "c bigint, p bigint")
    got = forest_of(H.hierarchy(df, "c", "p", spark.createDataFrame([(1,), (2,), (4,)], "k bigint")))
    assert got == {1: ("tree", 2, 1, [2, 1]), 2: ("tree", 2, 0, [2]), 4: ("on_cycle", 0, -1, None), 5: ("below_cycle", 0, -1, None)}
    assert H.hierarchy(df.limit(0), "c", "p").count() == 0


def test_descendants_are_listed_as_often_as_counted(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in K.p7_descendants(spark, sf).collect()]
    paths = [(r.link, [int(x) for x in r.path.split("/")], r.n_descendants) for r in K.p7_paths(spark, sf).collect()]
    want = {(link, a, path[-1], len(path) - 1 - i) for link, path, _ in paths for i, a in enumerate(path[:-1])}
    assert len(got) == len(want) == sum(n for *_, n in paths) > 0 and set(got) == want


def test_p7_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/wikidata_summary.parquet")
    d["no"] = [int(i.strip()[1:]) if isinstance(i, str) and i.strip() else None for i in d["id"]]
    cur = d[d.no.notna()].sort_values(["seen_at", "rec_no"], ascending=[False, True]).drop_duplicates("no")
    want = set()
    for link in K.LINKS:
        parent = {}
        for no, text in zip(cur.no, cur.properties, strict=True):
            for _, _, key, _, item in brute_items([(no, "p", text)]):
                if key == link:
                    parent[int(no)] = int(item[1:])
        known = set(cur.no.astype(int))
        parent = {n: p if p in known else None for n, p in parent.items()}
        for p in {p for p in parent.values() if p is not None} - set(parent):
            parent[p] = None
        want |= {(link, n, w[0], w[1], w[2]) for n, w in brute_forest(parent).items()}
    assert {tuple(r) for r in K.p7_found(spark, sf).collect()} == want and len({w[2] for w in want}) >= 2
