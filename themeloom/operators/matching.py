"""Finding a lexicon's surface forms in texts.

A text falls into segments: maximal runs of letters and digits, and every other character by itself. A form matches where its segments stand, so it never
begins or ends within a word, except that the last word may carry a plural s when the text goes on behind it. Of the matches, those within another are
dropped, and of two neighbours that overlap or touch the shorter one, or the later if both are equally long.

A lexicon whose bytes are proven few is a trie over segments that every task holds. A larger one is met in a join: tasks hold bit maps of a fixed size of its keys and their first segments, cut
from the texts what these don't rule out, and only that is shuffled, to the lexicon by language and key. Texts aren't shuffled in either way, and the lexicon isn't collected in the second.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .valuemap import ValueMap, value_map

MATCHES = "doc_id bigint, start int, stop int, key string"
_SEGMENT = re.compile(r"[^\W_]+|[\W_]", re.S)


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(text)


def trie_of(keys: list[str]) -> dict:
    """Nested dictionaries by segment; the key itself stands under the empty segment."""
    root: dict = {}
    for key in keys:
        node = root
        for seg in segments(key):
            node = node.setdefault(seg, {})
        node[""] = key
    return root


def find(text: str, trie: dict) -> Iterator[tuple[int, int, str]]:
    """``(start, stop, key)`` of every match: from each segment down the trie, as far as the text goes along."""
    segs = segments(text)
    starts, at = [], 0
    for s in segs:
        starts.append(at)
        at += len(s)
    n = len(segs)
    for i in range(n):
        node, j = trie, i
        while j < n:
            seg = segs[j]
            if j + 1 < n and len(seg) > 1 and seg[-1] in "sS" and seg.isalnum():
                singular = node.get(seg[:-1])
                if singular and "" in singular:  # a plural ends the match
                    yield starts[i], starts[j] + len(seg) - 1, singular[""]
            node = node.get(seg)
            if node is None:
                break
            j += 1
            if "" in node:
                yield starts[i], starts[j - 1] + len(seg), node[""]


def automaton_of(keys: list[str]) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    """Finds every occurrence of every key anywhere, for languages that don't part words; by the Aho-Corasick automaton where its library is there."""
    try:
        import ahocorasick
    except ImportError:
        ahocorasick = None
    if ahocorasick is None or not keys:

        def search(text: str) -> Iterator[tuple[int, int, str]]:
            for key in keys:
                i = text.find(key)
                while i >= 0:
                    yield i, i + len(key), key
                    i = text.find(key, i + 1)

        return search
    made = ahocorasick.Automaton()
    for key in keys:
        made.add_word(key, key)
    made.make_automaton()
    return lambda text: ((end + 1 - len(key), end + 1, key) for end, key in made.iter(text))


def resolved(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Matches without those within others, then without the shorter of neighbours that overlap or touch."""
    kept: list[tuple[int, int, str]] = []
    reach = -1
    for m in sorted(set(found), key=lambda m: (m[0], -m[1], m[2])):
        if m[1] > reach:
            kept.append(m)
            reach = m[1]
    gone = set()
    for a, b in zip(kept, kept[1:], strict=False):
        if a[1] >= b[0]:
            gone.add(b if b[1] - b[0] <= a[1] - a[0] else a)
    return [m for m in kept if m not in gone]


def resolve_overlaps(intervals: DataFrame) -> DataFrame:
    """The same for a table ``(doc_id, start, stop, key)`` of any origin, with window functions over each document."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "key")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = intervals.select("doc_id", "start", "stop", "key").distinct().withColumn("reach", before).where("reach is null or stop > reach")
    size = F.col("stop") - F.col("start")
    line = Window.partitionBy("doc_id").orderBy("start")
    next_start, next_size = F.lead("start").over(line), F.lead(size).over(line)
    last_stop, last_size = F.lag("stop").over(line), F.lag(size).over(line)
    marked = kept.withColumn("gone", F.coalesce((F.col("stop") >= next_start) & (size < next_size), F.lit(False)) | F.coalesce((last_stop >= F.col("start")) & (last_size >= size), F.lit(False)))
    return marked.where("not gone").select("doc_id", "start", "stop", "key")


def units(text: str, unparted: bool) -> list[str]:
    """What keys consist of: segments, or characters in languages that don't part words."""
    return list(text) if unparted else segments(text)


def hashed(code: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{code}\1{text}".encode("utf-8", "surrogatepass"))


def _key_hashes(keys: DataFrame, unparted: tuple[str, ...]) -> DataFrame:
    """``(lang, n, whole, first)`` of the keys: number of units, hash of the key and of its first unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts, whole, first = [], [], [], []
            for code, key in zip(*batch.to_pydict().values(), strict=True):
                parts = units(key, code in unparted)
                codes.append(code)
                counts.append(len(parts))
                whole.append(hashed(code, key))
                first.append(hashed(code, parts[0]))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(counts, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, first))], names=["lang", "n", "whole", "first"])

    return keys.select("lang", "key").mapInArrow(run, "lang string, n int, whole bigint, first bigint")


def possible(text: str, code: str, lengths: list[int], whole: ValueMap, first: ValueMap, unparted: bool) -> list[tuple[int, int, str]]:
    """``(start, stop, text)`` of the parts of a text that may be keys: as many units as some key has, not ruled out by the maps."""
    parts = units(text, unparted)
    starts = [0, *accumulate(len(x) for x in parts)]
    n = len(parts)
    plural = [not unparted and j + 1 < n and len(x) > 1 and x[-1] in "sS" and x.isalnum() for j, x in enumerate(parts)]
    heads = np.array([hashed(code, x) for x in parts] + [hashed(code, x[:-1]) for x in parts], np.uint64)
    may = first.may_have(heads)
    kept: list[tuple[int, int, str]] = []
    heads_at = np.flatnonzero(may[:n] | (may[n:] & np.array(plural, bool)))
    for block in range(0, len(heads_at), 4096):  # bounded, however long the text
        found: list[tuple[int, int, str]] = []
        for i in heads_at[block : block + 4096].tolist():
            for k in lengths:
                j = i + k - 1
                if j >= n:
                    break
                found.append((starts[i], starts[j + 1], text[starts[i] : starts[j + 1]]))
                if plural[j]:  # a plural ends the match
                    found.append((starts[i], starts[j + 1] - 1, text[starts[i] : starts[j + 1] - 1]))
        may_be = whole.may_have(np.array([hashed(code, x[2]) for x in found], np.uint64))
        kept += [x for x, k in zip(found, may_be.tolist(), strict=True) if k]
    return kept


def _by_join(docs: DataFrame, keys: DataFrame, known: set[str], fallback: str, unparted: tuple[str, ...]) -> DataFrame:
    """`MATCHES` of ``(doc_id, lang, text)``, all of them, by a join with the keys."""
    hashes = materialise(_key_hashes(keys, unparted))
    lengths: dict[str, list[int]] = {}
    for r in hashes.select("lang", "n").distinct().orderBy("lang", "n").collect():  # a row per language and length
        lengths.setdefault(r.lang, []).append(r.n)
    shared = docs.sparkSession.sparkContext.broadcast((value_map(hashes, "whole"), value_map(hashes, "first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, first = shared.value
        for batch in batches:
            out: list[tuple] = []
            for number, code, value in zip(*batch.to_pydict().values(), strict=True):
                code = code if code in known else fallback
                if code in lengths and value:
                    out += [(number, code, *x) for x in possible(value, code, lengths[code], whole, first, code in unparted)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "code", "start", "stop", "part"])

    cut = docs.mapInArrow(run, "doc_id bigint, code string, start int, stop int, part string")
    return cut.join(keys.select(F.col("lang").alias("code"), F.col("key").alias("part")), ["code", "part"]).select("doc_id", "start", "stop", F.col("part").alias("key"))


def mentions(docs: DataFrame, doc_id: str, text: str, lang: str, lexicon: DataFrame, fallback: str = "en", overlaps: bool = False, held_bytes: int = 4_000_000, unparted: tuple[str, ...] = ("th",)) -> DataFrame:
    """`MATCHES` of the keys of `lexicon(lang, key, ...)` in the texts, in each text's own language, or `fallback` where the lexicon hasn't that language.

    A language code counts in lower case and up to a hyphen. Line feeds count as spaces. With `overlaps` all matches are given. In the languages `unparted` keys may stand within words. Null
    and empty texts have none. Keys of up to `held_bytes` bytes in all are held by every task (a trie takes some twenty times as much), more are joined; the result is the same.
    """
    keys = materialise(lexicon.where("key <> ''").select("lang", "key").distinct())
    code = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), "[-_].*$", "")
    picked = spread(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), code.alias("lang"), F.translate(F.col(text), "\n", " ").alias("text")).where("length(text) > 0")
    known = {r.lang for r in keys.select("lang").distinct().collect()}
    if (keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0) > held_bytes:
        found = _by_join(picked, keys, known, fallback, unparted)
        return found if overlaps else resolve_overlaps(found)
    by_lang: dict[str, list[str]] = {}
    for r in keys.collect():
        by_lang.setdefault(r.lang, []).append(r.key)
    free = {code: of for code, of in by_lang.items() if code in unparted}
    shared = docs.sparkSession.sparkContext.broadcast({code: trie_of(of) for code, of in by_lang.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anywhere = {code: automaton_of(of) for code, of in free.items()}
        for batch in batches:
            out: list[tuple] = []
            for number, code, value in zip(*batch.to_pydict().values(), strict=True):
                code = code if code in known else fallback
                found = list(anywhere[code](value) if code in anywhere else find(value, shared.value.get(code, {})))
                out += [(number, *m) for m in (found if overlaps else resolved(found))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "start", "stop", "key"])

    return picked.mapInArrow(run, MATCHES)


def masked(docs: DataFrame, doc_id: str, text: str, found: DataFrame, mask: str = " __match__{} ") -> DataFrame:
    """``(doc_id, masked)``: each text with its mentions replaced by the mask around the key, spaces in the key as underscores; line feeds as spaces."""
    prefix, suffix = mask.split("{}")
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.translate(F.coalesce(F.col(text), F.lit("")), "\n", " ").alias("t"))
    spots = found.groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "key"))).alias("spots"))
    joined = given.join(spots, F.col("doc_id") == F.col("d"), "left")
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(prefix), F.translate(s["key"], " ", "_"), F.lit(suffix)).alias("out"), s["stop"].alias("at")
    )
    built = F.aggregate("spots", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    return joined.select("doc_id", F.when(F.col("spots").isNull(), F.col("t")).otherwise(built).alias("masked"))
