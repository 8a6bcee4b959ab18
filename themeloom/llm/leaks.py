"""Evaluation texts inside training texts: size-partitioned MinHash containment search with exact verification.

Texts are compared as streams of letters and digits: markup, case, accents, punctuation, spacing and the division into words are gone, while words' borders are
remembered beside. A case holds `words` consecutive words of an item with at most one of them replaced, so one of the item's runs of `words` // 2 words stands in the document
unchanged: as a set of byte shingles the run is contained in the document wholly.

The search is that of a containment index for small sets in large ones (Zhu, Nargesian, Pu and Miller). Runs are partitioned by size. A partition looks at the document as the sets of as many
neighbouring shingles as its smallest run has, one set from every place on, and at a run as its own first such set: a document that contains the run contains this set as one of its own. At equal sizes the
containment of 1 is a Jaccard similarity of 1, so that one MinHash value for each set finds every run; neighbouring sets mostly share theirs, and few values come of a document. A value of a document that is one of a run makes a candidate,
and a hash of the whole run in its place decides whether the run is contained.

Every task holds a bit map of the runs' signature values, which has a fixed largest size and rules out values that no run has. Items whose bytes are proven few are held by the tasks as well;
else what the map leaves, with the documents' streams around it, meets the runs in a join by value. Candidates are verified exactly, word by word on both sides of the common shingle. Documents are
never shuffled but for these surroundings.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.valuemap import ValueMap, value_map
from ..session import materialise, spread

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BLOCK_TAG = re.compile(r"<(?:/?(?:p|div|li|ul|ol|dl|dt|dd|tr|td|th|table|h[1-6]|blockquote|section|article|header|footer|title)|br|hr)\b[^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_DROP = re.compile(r"[\W_]+")
_ASCII_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
# fixed values: letters that don't decompose
_LETTERS = (("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i"))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd numbers
_ALL = (1 << 64) - 1
_POWER = 0xD6E8FEB86659FD93  # an odd number
_CHUNK = 1 << 18  # bytes of streams that are hashed at once
_HYPHENS = ("-", "\u00ad", "\u2010", "\u2011")


def unmarked(text: str) -> str:
    """The text without tags and with character references resolved."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return text


def stream(text: str) -> bytes:
    """Letters and digits only, without case and accents, as UTF-8."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_DROP)
    text = normalize("NFKD", text.casefold())
    for a, b in _LETTERS:
        text = text.replace(a, b)
    return _DROP.sub("", text).encode("utf-8", "ignore")


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """64-bit hashes of the shingles of k bytes (4, or a multiple of 8) at every place of `data`."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = min(k, 8)
    words = np.empty(n + k - step, np.uint64)  # the 4 or 8 bytes from each place on
    for j in range(min(step, len(words))):
        part = np.frombuffer(data, f"<u{step}", (len(data) - j) // step, j)
        words[j::step] = part[: len(range(j, len(words), step))]
    out = words[:n] * _MIX[0]
    for i in range(step, k, step):
        out = (out ^ (out >> np.uint64(29))) * _MIX[1] + words[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX[2]
    return out ^ (out >> np.uint64(29))


@dataclass
class Item:
    """One item's stream and the places where its words begin, with the end."""

    number: int
    data: bytes
    at: list[int]


def item_of(number: int, text: str | None) -> Item:
    at, parts = [0], []
    for word in unmarked(text or "").split():
        if part := stream(word):
            parts.append(part)
            at.append(at[-1] + len(part))
    return Item(number, b"".join(parts), at)


# bytes of a shingle, by the least size of a run in bytes: the longer, the fewer texts share one by chance; the run is contained wholly, so long ones lose nothing
SHINGLES = ((24, 36), (16, 20), (8, 12), (4, 0))


@dataclass(frozen=True)
class SizeClass:
    """A partition of the runs: those of at least `least` shingles of `k` bytes, and fewer than the next one's."""

    k: int
    least: int


def size_class(size: int) -> SizeClass:
    """The class of a run of `size` bytes: bounds grow by about the square root of two."""
    k = next(k for k, least in SHINGLES if size >= least)
    n = max(1, size - k + 1)
    i = math.floor(2 * math.log2(n) + 1e-9)
    return SizeClass(k, max(1, min(n, math.floor(2 ** (i / 2) + 1e-9))))


def substring_sums(data: bytes) -> np.ndarray:
    """Sums by which the bytes of any part of `data` can be hashed, see `part_hash`."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * powers(len(raw), _POWER), out=out[1:])
    return out


def powers(n: int, of: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, of
    while have < n:
        out[have : 2 * have] = out[: min(have, n - have)] * np.uint64(step)
        have, step = 2 * have, step * step & _ALL
    return out[:n]


def part_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the bytes from `start` to `stop`, the same wherever they stand."""
    return (sums[stop] - sums[start]) * powers(len(sums), pow(_POWER, -1, 1 << 64))[start]


def run_signatures(item: Item, words: int, run: int) -> Iterator[tuple[int, int, SizeClass, int, int]]:
    """``(signature value, its place, class, start, stop)`` of each run of `run` words of an item of at least `words` words."""
    if len(item.at) - 1 < words:
        return
    hashes: dict[int, np.ndarray] = {}
    for w in range(len(item.at) - run):
        a, b = item.at[w], item.at[w + run]
        of = size_class(b - a)
        if of.k not in hashes:
            hashes[of.k] = shingle_hashes(item.data, of.k)
        values = hashes[of.k][a : a + of.least]
        i = int(values.argmin())
        yield int(values[i]), a + i, of, a, b


def window_hits(data: bytes, classes: list[SizeClass], known: ValueMap) -> tuple[np.ndarray, np.ndarray]:
    """``(places, signature values)`` of the windows of `data` whose MinHash value may be that of a run, each pair once."""
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in sorted({c.k for c in classes}):
        hashes = shingle_hashes(data, k)
        least, have = hashes, 1
        for width in sorted(c.least for c in classes if c.k == k):
            if width > len(hashes):
                break
            while 2 * have <= width:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            rest = width - have
            of_window = np.minimum(least[:-rest], least[rest:]) if rest else least
            changed = np.flatnonzero(np.diff(of_window, prepend=of_window[:1] ^ np.uint64(1)))
            hit = changed[known.may_have(of_window[changed])]
            for start in range(0, len(hit), 4096):
                j = hit[start : start + 4096]
                at, place = np.nonzero(hashes[j[:, None] + np.arange(width)] == of_window[j][:, None])
                places.append(j[at] + place)
                found.append(of_window[j][at])
    p, v = np.concatenate(places), np.concatenate(found)
    order = np.lexsort((v, p))
    p, v = p[order], v[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return p[new], v[new]


def anchors(d: np.ndarray, p: np.ndarray, i: np.ndarray, q: np.ndarray, reach: int) -> np.ndarray:
    """Which of the equal places p of document d and q of item i to verify: of those on one diagonal no farther than `reach` from the one before, which one equal stretch holds, the first."""
    order = np.lexsort((p, p - q, i, d))
    d, p, i, q = d[order], p[order], i[order], q[order]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] - p[:-1] > reach)
    return order[new]


def word_borders(text: str) -> tuple[int, list[int]]:
    """``(length, borders)`` of a text's stream: where its words begin and end. A word that ends with a hyphen goes on in the next."""
    borders, at, joined = [0], 0, False
    for word in unmarked(text).split():
        if part := stream(word):
            if joined:
                borders.pop()
            at += len(part)
            borders.append(at)
        joined = word.endswith(_HYPHENS) and len(borders) > 1 if part else joined
    return at, borders


def surroundings(places: list[int], borders: list[int], length: int, reach: int) -> list[tuple[int, int]]:
    """The parts of a stream that decide about the candidates at `places`: `reach` bytes, the word there, and as many again, on both sides."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        i = max(bisect_right(borders, max(p - reach, 0)) - 1, 0)
        j = min(bisect_left(borders, p + reach), len(borders) - 1)
        a, b = max(borders[i] - reach, 0), min(borders[j] + reach, length)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def same_after(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes from a[i] and b[j] on are equal."""
    n = min(len(a) - i, len(b) - j)
    done, step = 0, 64
    while done < n:
        step = min(step, n - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            return done
        else:
            step //= 2
    return done


def same_before(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes before a[i] and b[j] are equal."""
    n = min(i, j)
    done, step = 0, 64
    while done < n:
        step = min(step, n - done)
        if a[i - done - step : i - done] == b[j - done - step : j - done]:
            done += step
            step *= 2
        elif step == 1:
            return done
        else:
            step //= 2
    return done


def holds(data: bytes, p: int, item: Item, q: int, words: int, borders: list[int]) -> bool:
    """Whether `data` holds `words` consecutive words of the item around the equal places p and q, one of them replaced at most by one word.

    `borders` are those of the words of `data`. A word counts as replaced when it and its neighbour part at a border and exactly one word stands in its place; that word may be of any
    length, and the first or the last of the passage.
    """
    at = item.at
    left, right = same_before(data, p, item.data, q), same_after(data, p, item.data, q)
    first, last = bisect_left(at, q - left), bisect_right(at, q + right) - 1  # words first .. last - 1 are whole
    if last - first >= words:
        return True
    if last - first < words // 2:
        return False  # a case has a longer unchanged part, which is a candidate of its own
    shift, total = p - q, len(at) - 1

    def border(place: int) -> int:
        i = bisect_left(borders, place)
        return i if i < len(borders) and borders[i] == place else -1

    for end in (last, last - 1):  # the replacing word may begin with the word that it replaces
        i = border(at[end] + shift) if first < end < total else -1
        if 0 <= i < len(borders) - 1:
            more = same_after(data, borders[i + 1], item.data, at[end + 1])
            if bisect_right(at, at[end + 1] + more) - 1 - first >= words:
                return True
    for begin in (first, first + 1):
        i = border(at[begin] + shift) if 0 < begin < last else -1
        if i > 0:
            more = same_before(data, borders[i - 1], item.data, at[begin - 1])
            if last - bisect_left(at, at[begin - 1] - more) >= words:
                return True
    return False


@dataclass(frozen=True)
class Index:
    """The runs by signature value, and the items they are of: for tasks to hold where it is small. Columns are value, item, place, start, stop and hash."""

    columns: tuple[np.ndarray, ...]
    items: list[Item]

    def contained(self, data: bytes, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index into p, item, place in the item)`` of the runs with these values that `data` contains around these places."""
        value, item, place, start, stop, hashed = self.columns
        left, right = np.searchsorted(value, v, side="left"), np.searchsorted(value, v, side="right")
        n = right - left
        of = np.repeat(np.arange(len(v)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        a, b = p[of] - (place[at] - start[at]), p[of] + (stop[at] - place[at])
        whole = (a >= 0) & (b <= len(data))
        of, at, a, b = of[whole], at[whole], a[whole], b[whole]
        if len(of):
            same = part_hash(substring_sums(data), a, b) == hashed[at]
            of, at = of[same], at[same]
        return of, item[at], place[at]


def _signatures(texts: DataFrame, words: int) -> DataFrame:
    """``(value, item, place, k, least, start, stop, hash)``, and with value null the size of the largest passage as ``stop``, of ``(item, t)``."""
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                item = item_of(number, text.as_py())
                sums = substring_sums(item.data)
                found = list(run_signatures(item, words, words // 2))
                hashes = part_hash(sums, np.array([x[3] for x in found], np.int64), np.array([x[4] for x in found], np.int64)).view(np.int64).tolist()
                for (value, place, of, a, b), h in zip(found, hashes, strict=True):
                    out.append((value - (1 << 64) if value >> 63 else value, number, place, of.k, of.least, a, b, h))
                out.append((None, number, 0, 0, 0, 0, max((b - a for a, b in zip(item.at, item.at[words + 2 :] or item.at[-1:], strict=False)), default=0), 0))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["value", "item", "place", "k", "least", "start", "stop", "hash"])

    return texts.select("item", "t").mapInArrow(run, "value bigint, item bigint, place int, k int, least int, start int, stop int, hash bigint")


def _pieces(streams: list[bytes], overlap: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The streams as ``(stream, offset, bytes)``, long ones in overlapping pieces, in groups of about `_CHUNK` bytes."""
    held, size = [], 0
    for d, data in enumerate(streams):
        for start in range(0, max(len(data), 1), _CHUNK):
            held.append((d, start, data[start : start + _CHUNK + overlap]))
            size += len(held[-1][2])
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _located(streams: list[bytes], classes: list[SizeClass], known: ValueMap, overlap: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, stream, shift, place, signature value)``: the hits in the streams, places being those in `data`, some pieces of streams, and shifted by `shift` those in the stream."""
    gap = bytes(32)
    for group in _pieces(streams, overlap):
        starts = np.cumsum([0, *(len(x) + len(gap) for _, _, x in group)])
        d, offset = np.array([x[0] for x in group]), np.array([x[1] for x in group])
        data = gap.join(x for _, _, x in group)
        p, v = window_hits(data, classes, known)
        i = np.searchsorted(starts, p, side="right") - 1
        yield data, d[i], offset[i] - starts[i], p, v


def _borders(text: str, data: bytes) -> list[int]:
    length, borders = word_borders(text)
    return borders if length == len(data) else [0, len(data)]


def _found_at_once(docs: DataFrame, classes: list[SizeClass], known: ValueMap, index: Index, words: int, overlap: int) -> DataFrame:
    """``(row, doc_id, item)`` of the cases, every task holding the index."""
    shared = docs.sparkSession.sparkContext.broadcast((known, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = shared.value
        for batch in batches:
            texts = batch.column(2)
            streams = [stream(unmarked(x.as_py())) for x in texts]
            cases: set[tuple[int, int]] = set()
            borders: dict[int, list[int]] = {}
            for data, d, shift, p, v in _located(streams, classes, known, overlap):
                of, i, q = index.contained(data, p, v)
                d, p = d[of], p[of] + shift[of]
                keep = anchors(d, p, i, q, min(c.k for c in classes))
                for a, b, c, e in zip(d[keep].tolist(), p[keep].tolist(), i[keep].tolist(), q[keep].tolist(), strict=True):
                    if (a, c) not in cases:
                        if a not in borders:
                            borders[a] = _borders(texts[a].as_py(), streams[a])
                        if holds(streams[a], b, index.items[c], e, words, borders[a]):
                            cases.add((a, c))
            rows = pa.array([a for a, _ in cases], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([index.items[c].number for _, c in cases], pa.int64())], names=["row", "doc_id", "item"])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, item bigint")


def _surrounded(docs: DataFrame, classes: list[SizeClass], known: ValueMap, reach: int, overlap: int) -> DataFrame:
    """``(row, doc_id, part, borders, values, places)``: the parts of the documents' streams that may hold runs, from ``(row, doc_id, t)``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    fields = (("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.binary()), ("borders", pa.list_(pa.int32())), ("values", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            texts = batch.column(2)
            streams = [stream(unmarked(x.as_py())) for x in texts]
            found: dict[int, list[tuple[int, int]]] = {}
            for _, d, shift, p, v in _located(streams, classes, shared.value, overlap):
                for a, b, c in zip(d.tolist(), (p + shift).tolist(), v.view(np.int64).tolist(), strict=True):
                    if b < len(streams[a]):
                        found.setdefault(a, []).append((b, c))
            for d, places in sorted(found.items()):
                data, borders = streams[d], _borders(texts[d].as_py(), streams[d])
                for a, b in surroundings([p for p, _ in places], borders, len(data), reach):
                    here = [(p, v) for p, v in places if a <= p < b]
                    row = (batch.column(0)[d].as_py(), batch.column(1)[d].as_py(), data[a:b], [x - a for x in borders[bisect_left(borders, a) : bisect_right(borders, b)]], [v for _, v in here], [p - a for p, _ in here])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, part binary, borders array<int>, values array<bigint>, places array<int>")


def _verified(candidates: DataFrame, words: int) -> DataFrame:
    """``(row, doc_id, item)`` of the candidates ``(row, doc_id, item, t, part, borders, spots)`` that are cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, Item] = {}
            kept = []
            for i, (number, text, data, borders, spots) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True)):
                if number not in known:
                    known[number] = item_of(number, text)
                if any(holds(data, s["p"], known[number], s["q"], words, borders) for s in spots):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in range(3)], names=["row", "doc_id", "item"])

    return candidates.select("row", "doc_id", "item", "t", "part", "borders", "spots").mapInArrow(run, "row bigint, doc_id bigint, item bigint")


def _found_by_join(docs: DataFrame, classes: list[SizeClass], known: ValueMap, signed: DataFrame, texts: DataFrame, words: int, overlap: int) -> DataFrame:
    """``(row, doc_id, item)`` of the cases, the parts of the documents that the map doesn't rule out joined with the runs by signature value."""
    runs = signed.where("value is not null")
    reach = signed.where("value is null").agg(F.max("stop")).first()[0]
    parts = materialise(_surrounded(docs, classes, known, reach, overlap)).withColumn("part_no", F.monotonically_increasing_id())
    spots = parts.select("part_no", F.explode(F.arrays_zip("values", "places")).alias("s")).select("part_no", F.col("s.values").alias("value"), F.col("s.places").alias("p"))
    met = spots.join(runs.select("value", "item", F.col("place").alias("q")).distinct(), "value").groupBy("part_no", "item").agg(F.collect_set(F.struct("p", "q")).alias("spots"))  # of one part
    return _verified(parts.select("part_no", "row", "doc_id", "part", "borders").join(met, "part_no").join(texts, "item"), words)


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, words: int = 15, most_bits: int = 27, held_bytes: int = 4_000_000) -> DataFrame:
    """``(doc_id, item_id)`` for each document and each item of which it holds at least `words` consecutive words, one of them replaced at most by one other word.

    Words are parted by white space; those without a letter or digit don't count. Items of fewer than `words` words, null and empty ones
    can't be found; null and empty documents hold nothing. A repeated item or document number gives its pairs once per row of the documents.
    Items of up to `held_bytes` bytes in all are held by every task with their runs (some 60 bytes a word), more meet the documents in a join; the result is the same.
    """
    given = materialise(items.select(F.col(item).cast("bigint").alias("number"), F.col(item_text).cast("string").alias("t")).where("number is not null and length(t) > 0"))
    texts = materialise(given.select("t").distinct().withColumn("item", F.monotonically_increasing_id()))
    signed = materialise(_signatures(texts, words))
    runs = signed.where("value is not null")
    picked = spread(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    if (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= held_bytes:
        held = [item_of(r.item, r.t) for r in texts.collect()]
        at = {x.number: i for i, x in enumerate(held)}
        rows = runs.toArrow()
        value, item_, place, k, least, start, stop, hashed = (rows.column(c).to_numpy().astype(np.int64) for c in rows.column_names)
        classes = [SizeClass(*x) for x in sorted(set(zip(k.tolist(), least.tolist(), strict=True)))]
        overlap = int((stop - start).max(initial=0))
        order = np.argsort(value.view(np.uint64), kind="stable")
        columns = (value.view(np.uint64), np.array([at[x] for x in item_.tolist()], np.int64), place, start, stop, hashed.view(np.uint64))
        known = ValueMap.of(value.view(np.uint64), most_bits)
        found = _found_at_once(picked, classes, known, Index(tuple(c[order] for c in columns), held), words, overlap) if classes else None
    else:
        classes = [SizeClass(r.k, r.least) for r in runs.select("k", "least").distinct().collect()]  # two for each doubling of the size
        known = value_map(runs, "value", most_bits)
        overlap = runs.agg(F.max(F.col("stop") - F.col("start"))).first()[0]  # the longest run
        found = _found_by_join(picked, classes, known, signed, texts, words, overlap) if classes else None
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    named = found.distinct().join(texts, "item").join(given, "t")
    return named.select("row", "doc_id", F.col("number").alias("item_id")).distinct().select("doc_id", "item_id")
