"""The training-data queries against their oracle SQL, and those without one over the smallest tables."""

import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connection, oracle_rows, rows_of

from themeloom.llm.queries import ORACLES, QUERIES, listed_entities


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, con, name):
    assert rows_of(QUERIES[name](spark, sf)) == oracle_rows(con, ORACLES[name])


def test_every_pair_comes_out(spark, sf):
    pages = [sorted(set(r.items)) for r in listed_entities(spark, sf).select("items").collect()]
    want = Counter(p for items in pages for p in combinations(items, 2))
    assert {(r.entity_a, r.entity_b): r.shared for r in QUERIES["p6_pairs"](spark, sf).collect()} == dict(want)
    assert min(want.values()) == 1


def test_packing_query(spark, sf):
    rows = QUERIES["p8_packed"](spark, sf).collect()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    size = {d: len((t or "").encode()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got, fill = Counter(), Counter()
    for r in rows:
        got[r.doc_id] += r.n
        fill[r.container] += r.n
    fill.pop(None, None)
    assert all(got[d] == n for d, n in size.items()) and max(fill.values()) <= 4096
    assert len(fill) <= 1.1 * -(-sum(size.values()) // 4096) + 1


def test_pieces_query(spark, sf):
    found = {r.doc_id for r in QUERIES["p10_found"](spark, sf).collect()}
    rows = QUERIES["p10_pieces"](spark, sf).collect()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    assert found == {r.doc_id for r in rows} == {d for d, t in docs.items() if len(t.encode()) > 2048}
    assert all(len(docs[r.doc_id].encode()[r.start : r.stop].decode()) for r in rows)


@pytest.mark.parametrize("name", ["p3_typical", "p4_found", "p9_found"])
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
