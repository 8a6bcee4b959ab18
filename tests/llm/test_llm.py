"""Training-data operators against brute force, and their defined edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import content, density, leaks, packing, pairs, pieces, terms, weights


@pytest.fixture(scope="module")
def baskets(spark):
    rng = random.Random(3)
    rows = [[rng.choice([None, 1, 1, 1, *range(2, 30)]) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    rows += [None, [], [None], list(range(1, 200)), [7] * 50]
    rows += rows[:20]  # repeated rows are records of their own
    return rows, spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(rows)], "rec bigint, items array<bigint>, n string, term int")


def clean(rows):
    return {i: [x for x in r or [] if x is not None] for i, r in enumerate(rows) if any(x is not None for x in r or [])}


def test_weights_equal_brute_force(baskets):
    rows, df = baskets
    given = clean(rows)
    n, mean = len(given), sum(map(len, given.values())) / len(given)
    m = Counter(x for r in given.values() for x in set(r))
    for k1, b, idf in ((1.2, 0.75, "probabilistic"), (math.inf, 0.0, "plain")):
        got = {(r.rec, r.term): r.weight for r in weights.term_weights(df, "rec", "items", k1, b, idf, 2).collect()}
        want = {}
        for i, r in given.items():
            for x, c in Counter(r).items():
                if m[x] >= 2:
                    known = math.log(n / m[x]) if idf == "plain" else math.log(1 + (n - m[x] + 0.5) / (m[x] + 0.5))
                    want[i, x] = known * (c if math.isinf(k1) else c * (k1 + 1) / (c + k1 * (1 - b + b * len(r) / mean)))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    best = {r.rec: r.term for r in weights.most_characteristic(weights.term_weights(df, "rec", "items", math.inf, 0.0, "plain", 2)).collect()}
    by = defaultdict(list)
    for (i, x), w in want.items():
        by[i].append((-round(w, 6), x))
    assert best == {i: min(v)[1] for i, v in by.items()}


def test_weights_reject_and_empty(spark):
    empty = spark.createDataFrame([], "r bigint, t array<string>")
    assert weights.term_weights(empty, "r", "t").count() == 0
    with pytest.raises(ValueError):
        weights.term_weights(empty, "r", "t", b=2)


@pytest.mark.parametrize("longest", [1, 3])
def test_ngrams_equal_brute_force(baskets, longest):
    rows, df = baskets
    occurrences, records = Counter(), Counter()
    for r in clean(rows).values():
        grams = [tuple(r[i : i + k]) for k in range(1, longest + 1) for i in range(len(r) - k + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in terms.ngram_counts(df, "items", longest).collect()}
    assert got == {g: (occurrences[g], records[g]) for g in occurrences}


def test_ngrams_marks_strings_and_empty(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), (["c"] * 4,), (None,)], "t array<string>")
    got = terms.mark(terms.ngram_counts(df, "t", 1, "string"), 3, 2, 0.5)
    assert {r.ngram[0]: r.mark for r in got.collect()} == {"a": "common", "b": "rare", "c": None}
    assert terms.ngram_counts(df.limit(0), "t", 2, "string").count() == 0


@pytest.mark.parametrize(("shared", "lift"), [(1, None), (3, 1.2)])
def test_pairs_equal_brute_force(baskets, shared, lift):
    rows, df = baskets
    given = clean(rows)
    n = len(given)
    m = Counter(x for r in given.values() for x in set(r))
    c = Counter(p for r in given.values() for p in combinations(sorted(set(r)), 2))
    got = {(r.a, r.b): (r.shared, round(r.lift, 9)) for r in pairs.pair_counts(df, "items", shared, lift).collect()}
    want = {(a, b): (k, round(k * n / (m[a] * m[b]), 9)) for (a, b), k in c.items() if k >= shared and (lift is None or k * n >= lift * m[a] * m[b])}
    assert got == want


@pytest.mark.parametrize("long", [1, 3, 50])
def test_pairs_of_long_records_are_parted(baskets, long):
    rows, df = baskets
    c = Counter(p for r in clean(rows).values() for p in combinations(sorted(set(r)), 2))
    assert {(r.a, r.b): r.shared for r in pairs.pair_counts(df, "items", long=long).collect()} == dict(c)


@pytest.mark.parametrize("share", [0.5, 0.001])
def test_ngrams_with_hot_prefixes_of_any_length(spark, share):
    rng = random.Random(11)
    rows = [[1, 1, rng.choice([1, 2, 3]), rng.randint(1, 50)] for _ in range(300)] + [[4, 5], [1]]
    occurrences = Counter(tuple(r[i : i + k]) for r in rows for k in range(1, 5) for i in range(len(r) - k + 1))
    got = {tuple(r.ngram): r.occurrences for r in terms.ngram_counts(spark.createDataFrame([(r,) for r in rows], "t array<bigint>"), "t", 4, hot_share=share).collect()}
    assert got == dict(occurrences)


def test_a_line_on_many_small_sites_is_a_template(spark):
    """Each of the sites has one page only."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(4))
    rows = [(k, f"s{k}.example", f"T {word()}", "We value your privacy and use cookies.\n" + " ".join(word() for _ in range(30)) + ".", None) for k in range(200)]
    df = spark.createDataFrame(rows, "page_no bigint, site string, enwiki string, text string, page string")
    for keys in (2_000_000, 0):
        assert {tuple(r) for r in content.other_lines(df, "page_no", "site", "enwiki", "text", "page", broadcast_keys=keys).collect()} == {(k, 0) for k in range(200)}


def test_gram_block_in_slices():
    rng = np.random.default_rng(1)
    x = rng.random((40, 25)) < 0.3
    x[3] = True  # one very long record
    rows, cols = np.nonzero(x)
    want = np.triu(x.astype(int).T @ x.astype(int), 1)
    for products in (5, 10_000):
        got = np.zeros_like(want)
        for i, j, k in pairs.gram_block(rows, cols, products):
            np.add.at(got, (i, j), k)
        assert (got == want).all()


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, None, 100, 4096, 8192, 10_000, rng.randint(1, 6000)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc bigint, size int, container string")
    rows = packing.pack(df, "doc", "size", 4096, shard_items=500).collect()
    of, fill = defaultdict(list), Counter()
    for r in rows:
        of[r.item].append((r.piece, r.start, r.n))
        if r.container is not None:
            fill[r.container] += r.n
    for i, s in enumerate(sizes):
        parts = sorted(of[i])
        assert sum(n for _, _, n in parts) == (s or 0) and len(parts) == max(1, -(-(s or 0) // 4096))
        assert all(p == k and start == k * 4096 for k, (p, start, _) in enumerate(parts))
    assert max(fill.values()) <= 4096 and all(r.used == fill[r.container] for r in rows if r.container is not None)
    assert sum(fill.values()) / (4096 * len(fill)) > 0.97
    assert packing.pack(df.limit(0), "doc", "size", 4096).count() == 0
    odd = packing.pack(spark.createDataFrame([(None, 10), (None, 10), (1, 30), (1, 30), (2, -5), (3, 250)], "doc bigint, size int"), "doc", "size", 100).collect()
    assert Counter((r.item, r.n) for r in odd) == {(None, 10): 2, (1, 30): 2, (2, 0): 1, (3, 100): 2, (3, 50): 1} and len({r.container for r in odd if r.n not in (0, 100)}) == 2


def test_oversized_texts_are_cut_between_characters(spark):
    texts = {1: "é" * 75, 2: "a" * 100, 3: "ぅ" * 100, 4: "a" * 99 + "😀" * 30, 5: None, 6: "", 7: "x" * 200}
    sizes = packing.text_sizes(spark.createDataFrame(list(texts.items()), "d bigint, t string"), "d", "t", 100)
    rows = packing.pack(sizes, "doc", "size", 100, cuts="cuts").collect()
    for d, t in texts.items():
        data = (t or "").encode()
        parts = [data[r.start : r.start + r.n] for r in sorted(rows, key=lambda r: r.piece) if r.item == d]
        assert b"".join(parts) == data and all(len(x) <= 100 for x in parts) and "".join(x.decode() for x in parts) == (t or "")
    fill = Counter()
    for r in rows:
        fill[r.container] += r.n
    assert all(r.used is None or r.used == fill[r.container] <= 100 for r in rows)


def test_sum_of_squares_takes_the_best_place():
    rng = random.Random(6)
    sizes, capacity = [rng.randint(1, 20) for _ in range(300)], 20
    got = packing.sum_of_squares(np.array(sizes), capacity)
    fill: dict[int, int] = {}
    cost = lambda f: sum(k * k for g, k in Counter(capacity - v for v in f.values()).items() if 0 < g < capacity)
    for s, c in zip(sizes, got.tolist(), strict=True):
        costs = {b: cost({**fill, b: fill.get(b, 0) + s}) for b in [*fill, len(fill)] if fill.get(b, 0) + s <= capacity}
        assert costs[c] == min(costs.values())
        fill[c] = fill.get(c, 0) + s


def brute_pieces(data, limit, overlap):
    """Walks from cut to cut, trying every place."""
    text_starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80]
    line = {i + 1 for i, b in enumerate(data) if b in b"\r\n" and data[i : i + 2] != b"\r\n"}
    space = {i + 1 for i, b in enumerate(data) if b in b"\r\n\t " and data[i : i + 2] != b"\r\n"}
    out, cut, start = [], 0, 0
    while True:
        if start + limit >= len(data):
            out.append((start, len(data)))
            return out
        for level in (line, space, set(text_starts)):
            reach = [p for p in level if cut + overlap + 4 < p <= start + limit]
            if reach:
                break
        cut = max(reach)
        out.append((start, cut))
        start = max(p for p in text_starts if p <= cut - overlap)


@pytest.mark.parametrize("window", [1 << 22, 200])
def test_pieces_equal_brute_force(monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW", window)
    rng = random.Random(7)
    texts = []
    for _ in range(150):
        weight = rng.choice([1, 9, 40])
        texts.append("".join(rng.choice(["a", "é", "ぅ", " ", "\r\n", "\n", "\t", *["bcdefgh" * rng.randint(1, 9)] * weight]) for _ in range(rng.randint(10, 100))))
    texts += ["\n" * 1000, " " * 500, "x" * 64 + "\n" + "y" * 64, "x" * 64 + " " + "y" * 64 + "\n", "x" * 65 + "\n", "é" * 400]
    texts = [t for t in texts if len(t.encode()) > 64]
    data = [t.encode() for t in texts]
    want = [(i, *piece) for i, d in enumerate(data) for piece in brute_pieces(d, 64, 10)]
    assert [x[:3] for x in pieces.split_all(data, 64, 10)] == want
    for t, level in zip(texts, pieces.natural_levels(data, 64), strict=True):
        longest = lambda p: max(len(x.encode()) for x in re.split(p, t))  # noqa: B023, E731
        assert pieces.KINDS[level] == ("line" if longest("[\r\n]") <= 64 else "space" if longest("[\r\n\t ]") <= 64 else "hard")


def test_pieces_cover_the_texts(spark):
    rows = [(1, "a b " * 2000, 1), (1, "a b " * 2000, 1), (2, None, 1), (3, "", 1), (4, "x" * 2048, 1), (5, "é" * 300_000, 1), (None, "y" * 2049, 1)]
    df = spark.createDataFrame(rows, "doc bigint, text string, piece int")
    got = pieces.split_texts(df, "doc", "text", 2048, 128).collect()
    assert Counter(r.doc for r in got if r.piece == 0) == {1: 2, 5: 1, None: 1}
    assert all(0 < r.stop - r.start <= 2048 for r in got) and {r.cut for r in got if r.doc == 1} == {"space", "end"}
    assert {r.doc_kind for r in got if r.doc == 5} == {"hard"} and max(r.stop for r in got if r.doc == 5) == 600_000
    assert pieces.split_texts(df.limit(0), "doc", "text", 2048, 128).count() == 0
    with pytest.raises(ValueError):
        pieces.split_texts(df, "doc", "text", 100, 60)


WORDS = [a + b + c for a in ("ba", "ko", "lu", "é", "ž") for b in ("ra", "ti", "mo") for c in ("", "n", "ß", "sk")]


def test_leaks_are_found_whatever_was_done_to_them(spark):
    rng = random.Random(8)
    item = [rng.choice(WORDS) for _ in range(40)]
    filler = lambda n: [rng.choice(WORDS) + "q" for _ in range(n)]
    part = item[10:25]
    replaced = [*part[:7], "zzz", *part[8:]]
    plain = lambda words: " ".join([*filler(30), *words, *filler(30)])
    texts = {
        1: plain(part), 2: plain(part).upper(), 3: "> " + "\r\n> ".join([*filler(9), *part, *filler(9)]), 4: plain(["<b>" + w + "</b>," for w in part]), 5: plain([w[:2] + "­-\n" + w[2:] for w in part]),
        6: plain(replaced), 7: "".join(part), 8: plain([*part[:3], "zzz", *part[4:]]), 9: plain(["«" + w.replace("é", "é").replace("ž", "z") + "»&nbsp;" for w in part]), 10: " ".join(filler(40_000) + part), 11: plain([*item[6:10], "zzz", *item[11:25]]), 12: plain([*item[10:24], "zzz", *item[25:29]]),
        31: plain([*part[:7], "z" * 41, *part[8:]]), 32: plain([*part[:7], "z" * 5000, *part[8:]]), 33: plain(["zzz", *part[1:]]), 34: plain([*part[:14], "zzz"]), 35: plain(part[:14]), 36: plain([*part[:7], part[7] + "zzz", *part[8:]]), 37: plain([*part[:7], "zzz" + part[7], *part[8:]]),
        38: plain([*part[:7], "zz-\n", "zz", *part[8:]]), 39: "<p>" + "</p><p>".join([*filler(9), *part[:7], "zzz", *part[8:]]) + "</p>",
        21: plain(part[:13]), 22: plain(item[:12]), 27: plain([*part[:7], *part[8:]]), 28: plain([*part[:7], "z", "zz", "zzz", "zzzz", *part[8:]]), 29: " ".join(part[:14]), 23: plain([*part[:5], "zzz", *part[6:9], "yyy", *part[10:]]), 24: None, 25: "", 26: plain([]),
    }
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(5, " ".join(item)), (6, " ".join([*filler(9), *item[5:30]])), (7, " ".join(item[:10])), (8, None), (9, "")], "item_id bigint, text string")
    for bits, held in ((27, 4_000_000), (27, 0), (8, 0)):  # a map of 256 bits rules out next to nothing
        got = {tuple(r) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text", most_bits=bits, held_bytes=held).collect()}
        assert got == {(d, i) for d in [*range(1, 13), *range(31, 40)] for i in (5, 6)}
    assert leaks.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_leaks_repeated_documents_and_short_words(spark):
    item = " ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "o", "p", "q"])
    docs = spark.createDataFrame([(1, "x y " + item[2:]), (1, "x y " + item[2:])], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, 5)] * 2


def test_every_run_is_met_and_contained():
    """Recall of the signatures alone, before anything is verified, for runs of all sizes anywhere in a stream."""
    for size in range(7, 3000):
        of = leaks.size_class(size)
        assert 1 <= of.least <= size - of.k + 1 < 2 * of.least + 1
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 2, 3, 5, 9, 30])))
    items = [leaks.item_of(i, " ".join(word() for _ in range(30))) for i in range(200)]
    everything = leaks.ValueMap(6, np.array([~np.uint64(0)]))
    for item in items:
        signed = list(leaks.run_signatures(item, 15, 7))
        w = rng.randrange(len(signed))
        value, place, of, a, b = signed[w]
        before = "".join(word() for _ in range(rng.randint(0, 50))).encode()
        data = before + item.data[a:b] + "".join(word() for _ in range(rng.randint(0, 50))).encode()
        p, v = leaks.window_hits(data, [of], everything)
        index = leaks.Index((np.array([value], np.uint64), np.array([0]), np.array([place]), np.array([a]), np.array([b]), leaks.part_hash(leaks.substring_sums(item.data), np.array([a]), np.array([b]))), [item])
        at, i, q = index.contained(data, p, v)
        assert len(before) - a in set((p[at] - q).tolist())


def brute_groups(x, threshold=0.8):
    label = list(range(len(x)))
    near = x @ x.T >= threshold
    for _ in range(len(x)):
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
        if new == label:
            return label
        label = new


def test_clusters_equal_brute_force_even_with_full_cells(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    sizes = [150, 90, 60, *rng.integers(1, 8, 37).tolist()]
    x = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(n, 16)) * 0.07 for c, n in zip(centres, sizes, strict=True)])
    x = np.concatenate([x, x[:40]])  # copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    scale = rng.choice([1.0, 0.001, 500.0], len(x))[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate((x * scale).astype(np.float32))]
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [math.nan] * 16, 1), (9004, [1.0] * 15, 1), (9005, [math.inf] * 16, 1), (9006, [None, *[1.0] * 15], 1)]
    df = spark.createDataFrame(rows, "rec bigint, v array<float>, cluster int")
    want = brute_groups(x)
    for cell_rows in (2048, 60):
        got = density.density_peaks(df, "rec", "v", 16, cell_rows=cell_rows).collect()
        assert {r.rec: r.cluster for r in got} == dict(enumerate(want))
    assert {r.rec: r.size for r in got} == {i: want.count(c) for i, c in enumerate(want)}
    top = density.typical(density.density_peaks(df, "rec", "v", 16), 2).collect()
    assert all(want[r.member] == r.cluster for r in top) and Counter(r.cluster for r in top) == {c: min(2, want.count(c)) for c in set(want)}
    assert density.density_peaks(df.where("rec > 9000"), "rec", "v", 16).count() == 0


def test_densities_are_exact_counts(spark):
    """A group of a third of all rows, with cells and blocks far smaller than it, and copies."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    of = np.where(np.arange(900) < 300, 0, rng.integers(1, 40, 900))
    x = centres[of] + rng.normal(size=(900, 16)) * 0.5
    x[880:890] = x[:10]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "rec long, v array<double>")
    for cell_rows, block_rows in ((40, 50), (2048, 8192)):
        got = density.density_peaks(df, "rec", "v", 16, cell_rows=cell_rows, block_rows=block_rows).collect()
        cluster = np.array([r.cluster for r in sorted(got)])
        near = (x @ x.T >= 0.8) & (cluster[:, None] == cluster)
        assert len(got) == 900 and {r.rec: r.density for r in got} == dict(enumerate(near.sum(axis=1)))


def test_cell_pointers_lead_to_the_nearest_denser():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rho = density.cell_density(x, np.ones(50), 0.8)
    ids = rng.permutation(50)
    got = {i: (j, round(c, 5)) for i, j, c in zip(*density.cell_pointers(ids, x, rho, 0.8), strict=True)}
    for k in range(50):
        denser = [(float(x[k] @ x[j]), j) for j in range(50) if (rho[j], -ids[j]) > (rho[k], -ids[k]) and x[k] @ x[j] >= 0.8]
        assert got.get(ids[k], (None, None))[1] == (round(max(denser)[0], 5) if denser else None)


SITE = ["Home", "About us", "By continuing you accept our cookie policy.", "{t}", "Last edited on {n} May 20{n}", "{s}", "Listen to this article ({n} min)", "{h}", "{s}", "{l}", "Read next: {w} and the {w}", "Categories: {w} | {w}", "© 20{n} Site. All rights reserved."]


def page_of(rng, k):
    words = lambda n: " ".join("".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))
    fills = {"{t}": f"Title {words(1).title()}", "{n}": str(rng.randint(10, 28)), "{h}": rng.choice(["History", "Home", "Legacy"])}
    lines, tags = [], []
    for x in SITE:
        line = x.replace("{s}", words(30).capitalize() + ".").replace("{l}", f"{words(2).title()}, {words(1)} ({rng.randint(1000, 2000)})")
        for a, b in fills.items():
            line = line.replace(a, b)
        while "{w}" in line:
            line = line.replace("{w}", words(1).title(), 1)
        lines.append(line)
        tags.append("h1" if x == "{t}" else "h2" if x == "{h}" else "p")
    html = "<html><body>" + "\n".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, lines, strict=True)) + "</body></html>"
    keep = {i for i, x in enumerate(SITE) if x in ("{t}", "{s}", "{h}", "{l}")}
    return fills["{t}"], "\n".join(lines), html, keep


def test_content_keeps_the_article(spark):
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(120):
        title, text, html, keep = page_of(rng, k)
        bare = k % 6 == 0
        rows.append((k, f"s{k % 3}.example", title.replace(" ", "_") if k % 2 else title, text, None if bare else html, "x"))
        want |= {(k, i) for i in range(len(SITE)) if i not in keep}
    rows += [(900, "s1.example", "T", None, None, "x"), (901, "s1.example", None, "", "", "x"), (902, None, None, "\n", "<p", "x"), (903, "s1.example", "T", "Word " * 200_000 + "end.", "<b>" * 1000, "x")]
    df = spark.createDataFrame([*rows, *[r for r in rows if r[0] == 5]], "page_no bigint, site string, enwiki string, text string, page string, line_no string")
    got = [tuple(r) for r in content.other_lines(df, "page_no", "site", "enwiki", "text", "page").collect()]
    assert {x for x in got if x[0] < 900} == want
    assert {x for x in got if x[0] >= 900} == {(902, 0), (902, 1)}
    assert Counter(x[0] for x in got)[5] == 2 * Counter(x[0] for x in want)[5]
    salted = {tuple(r) for r in content.other_lines(df, "page_no", "site", "enwiki", "text", "page", broadcast_keys=0).collect()}
    assert salted == set(got)
    assert content.other_lines(df.limit(0), "page_no", "site", "enwiki", "text", "page").count() == 0


def test_blocks_survive_broken_markup():
    got = content.Blocks().read("<nav><p>menu</nav><h2>A <i>b</i></h2><p><b>Head</b><p><b>c</b> d<br>e&amp;f</div><script>x<y</script>")
    assert [(t, k) for t, _, k in got] == [("menu", content.ASIDE), ("A b", content.HEADING), ("Head", content.HEADING), ("c d", content.PLAIN), ("e&f", content.PLAIN), ("x<y", content.ASIDE)]


def test_clusters_are_whole_when_cells_are_many_times_too_full(spark, monkeypatch):
    """2,000 close pairs and a group of a third of all rows, with four pivots: cells sixty times their bound."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(2000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    hot = rng.normal(size=32)
    x = np.concatenate([np.repeat(base, 2, axis=0), np.tile(hot / np.linalg.norm(hot), (2000, 1))])
    x = x + rng.normal(size=x.shape) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "rec bigint, v array<float>")
    monkeypatch.setattr(density, "_MAX_PIVOTS", 4)
    for exact in (False, True):
        got = {r.rec: r.cluster for r in density.density_peaks(df, "rec", "v", 32, cell_rows=50, densities=False, exact=exact, block_rows=3000).collect()}
        whole = sum(got[i] == got[i + 1] == i for i in range(0, 4000, 2))
        assert (whole == 2000 if exact else whole >= 1990) and {got[i] for i in range(4000, 6000)} == {4000}, whole
