"""Splitting oversized texts at natural boundaries, by pointer doubling.

Sizes are tokens of the byte tokenizer, one for each byte of the UTF-8 text. A cut joins two consecutive pieces: the next piece begins `overlap` tokens
before it. Every possible cut of a text is a node that points to its farthest legal successor, and squaring the successor table - the successor of the
successor, of that, and so on - marks all cuts of the greedy division in a logarithmic number of passes over whole arrays, with no walk from cut to cut.
Texts are laid out one behind the other and share the tables; a text longer than `WINDOW` takes part with one window after another, so memory is bounded whatever its length. The operator is one
narrow stage without a shuffle.

How natural a text's boundaries are is read off the same kind of table: of the levels of boundaries, the first at which the successors, nothing shared, lead from the text's start to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

PIECES = "doc bigint, n bigint, doc_kind string, piece int, start bigint, stop bigint, cut string"
_ARROW = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("doc_kind", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("cut", pa.string())])
KINDS = ("line", "space", "hard", "end")
WINDOW = 1 << 22


def farthest(bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each pair the largest of the sorted `bounds` in (low, high], or -1."""
    if not len(bounds):
        return np.full(len(low), -1, np.int64)
    i = np.searchsorted(bounds, high, side="right") - 1
    found = bounds[np.maximum(i, 0)]
    return np.where((i >= 0) & (found > low), found, -1)


def merged(n: int, *places: np.ndarray) -> np.ndarray:
    """The places up to n that are in any of the arrays, in order."""
    mask = np.zeros(n + 1, bool)
    for x in places:
        mask[x] = True
    return np.flatnonzero(mask)


class Layout:
    """Texts in one buffer, with a byte behind each that is neither a break nor part of a character."""

    def __init__(self, parts: list[bytes]) -> None:
        self.raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
        size = np.array([len(x) for x in parts], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.base = self.end - size

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1


def doubled(jump: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Where following `jump` (an index of a node, itself at the end) from the roots ends, by squaring the table."""
    at = jump[roots]
    while True:
        jump = jump[jump]
        on = jump[at]
        if (on == at).all():
            return at
        at = on


def breaks_of(raw: np.ndarray, level: int) -> np.ndarray:
    """Places of the breaks: line breaks at level 0, tabs and spaces too at level 1."""
    found = (raw == 13) | (raw == 10)
    return np.flatnonzero(found if level == 0 else found | (raw == 9) | (raw == 32))


def reached(parts: list[bytes], last: list[bool], level: int, limit: int) -> np.ndarray:
    """How far the successors of a level lead in each text, `limit` tokens at most at a time. Boundaries are before and behind every break, and the end of a part that is its text's last."""
    of = Layout(parts)
    breaks = breaks_of(of.raw, level)
    nodes = bounds = merged(len(of.raw), of.base, breaks, breaks + 1, of.end[np.array(last, bool)])
    to = farthest(bounds, nodes, np.minimum(nodes + limit, of.end[of.text_of(nodes)]))
    jump = np.searchsorted(nodes, np.where(to < 0, nodes, to))
    return nodes[doubled(jump, np.searchsorted(nodes, of.base))] - of.base


def _grouped(texts: list[bytes], at: dict[int, int]) -> Iterator[tuple[list[int], list[bytes], list[bool]]]:
    """The next windows of the texts in `at` (text -> place), some `WINDOW` bytes together at a time, and whether each is its text's last."""
    group: list[int] = []
    size, final = 0, max(at)
    for t in sorted(at):
        group.append(t)
        size += min(WINDOW, len(texts[t]) - at[t])
        if size >= WINDOW or t == final:
            yield group, [texts[x][at[x] : at[x] + WINDOW] for x in group], [at[x] + WINDOW >= len(texts[x]) for x in group]
            group, size = [], 0


def natural_levels(texts: list[bytes], limit: int) -> list[int]:
    """For each text the first level (index into KINDS) whose boundaries alone lead to its end."""
    out = [2] * len(texts)
    left = set(range(len(texts)))
    for level in (0, 1):
        at = dict.fromkeys(left, 0)
        while at:
            for group, parts, last in list(_grouped(texts, at)):
                for t, part, final, n in zip(group, parts, last, reached(parts, last, level, limit).tolist(), strict=True):
                    if final or n + limit < len(part):
                        if final and n == len(part):
                            out[t] = level
                            left.discard(t)
                        del at[t]
                    else:
                        at[t] += n
    return out


def successors(nodes: np.ndarray, levels: list[np.ndarray], end: np.ndarray, limit: int, overlap: int, shared: np.ndarray) -> np.ndarray:
    """The farthest legal cut after each node: at the first level that has one, the text's `end` where the rest fits.

    A piece reaches from node - shared to its cut and has at most `limit` tokens, more than `overlap` of them new, so that the next piece can share as
    many with it. `levels` are boundaries, the most natural first.
    """
    high = nodes - shared + limit
    out = np.where(high >= end, end, -1)
    for bounds in levels:
        open_ = out < 0
        if not open_.any():
            break
        out[open_] = farthest(bounds, nodes[open_] + overlap + 4, high[open_])
    return out


def greedy_cuts(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The nodes met from the roots by following `succ` (an index of a node, itself at the end), by squaring the table."""
    met = np.zeros(len(succ), bool)
    met[roots] = True
    jump = succ.copy()
    while True:
        before = np.count_nonzero(met)
        met[jump[met]] = True
        if np.count_nonzero(met) == before:
            return np.flatnonzero(met)
        jump = jump[jump]


def cut_parts(parts: list[bytes], leads: list[int], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(part, start, stop, level of the cut)`` of all pieces, in order. The first piece of a part begins `lead` tokens before the cut it follows."""
    of = Layout(parts)
    raw, n = of.raw, len(of.raw)
    cr, lf = raw == 13, raw == 10
    inside = np.zeros(n + 1, bool)  # CR | LF isn't a boundary
    inside[1:n] = cr[:-1] & lf[1:]
    lines, spaces = (x[~inside[x]] for x in (breaks_of(raw, 0) + 1, breaks_of(raw, 1) + 1))
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    roots = of.base + np.array(leads, np.int64)
    # nodes: natural boundaries, and those between characters where a stretch is too long for natural ones alone
    edges = merged(n, of.base, spaces, of.end)
    wide = np.flatnonzero(np.diff(edges) > limit - overlap - 4)
    low = np.searchsorted(chars, edges[wide])
    high = np.searchsorted(chars, np.minimum(edges[wide + 1] + limit, of.end[of.text_of(edges[wide])]))
    open_ = np.cumsum(np.bincount(low, minlength=len(chars) + 1) - np.bincount(high, minlength=len(chars) + 1))[:-1] > 0
    nodes = merged(n, roots, of.base, spaces, chars[open_], of.end)
    while True:
        text = of.text_of(nodes)
        back = np.maximum(nodes - overlap, of.base[text])
        shared = nodes - chars[np.maximum(np.searchsorted(chars, back, side="right") - 1, 0)]
        shared[np.searchsorted(nodes, of.base)] = 0
        shared[np.searchsorted(nodes, roots)] = leads
        to = successors(nodes, [lines, spaces, chars], of.end[text], limit, overlap, shared)
        index = np.searchsorted(nodes, to)
        missing = nodes[np.minimum(index, len(nodes) - 1)] != to
        if not missing.any():
            break
        odd = np.isin(of.text_of(chars), np.unique(text[missing]))  # a cut between characters that is no node yet: all characters of such texts
        nodes = merged(n, nodes, chars[odd])
    cuts = greedy_cuts(index, np.searchsorted(nodes, roots))
    at, mine = nodes[cuts], text[cuts]
    goes_on = np.flatnonzero(mine[:-1] == mine[1:])
    starts, stops, part = (at - shared[cuts])[goes_on], at[goes_on + 1], mine[goes_on]
    natural = np.full(n + 1, 2, np.int8)
    natural[spaces], natural[lines] = 1, 0
    level = np.where(stops == of.end[part], 3, natural[stops])
    return part, starts - of.base[part], stops - of.base[part], level


def split_all(texts: list[bytes], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(text, start, stop, index into KINDS of the cut)`` of the pieces of texts of more than `limit` bytes, in order.

    Pieces cover the text, none exceeds `limit`, and each begins `overlap` bytes before the cut it follows, or up to three more where that would be within a
    character. A cut is behind a line break (CR LF is one) where one can be reached, else behind a tab or space, else between two characters.
    """
    out: list[tuple[int, int, int, int]] = []
    at, lead = dict.fromkeys(range(len(texts)), 0), dict.fromkeys(range(len(texts)), 0)
    while at:
        for group, parts, last in list(_grouped(texts, at)):
            base = {i: at[t] for i, t in enumerate(group)}
            for i, start, stop, level in zip(*(x.tolist() for x in cut_parts(parts, [lead[t] for t in group], limit, overlap)), strict=True):
                t = group[i]
                if t not in at or at[t] != base[i]:
                    continue
                if last[i] or start + limit < len(parts[i]):  # else the window's end has a say in it: the next window begins with this piece
                    out.append((t, base[i] + start, base[i] + stop, level))
                    before = stop
                else:
                    at[t], lead[t] = base[i] + start, before - start
            for i, t in enumerate(group):
                if last[i]:
                    del at[t]
    return sorted(out)


def split_texts(docs: DataFrame, doc: str, text: str, limit: int, overlap: int) -> DataFrame:
    """`PIECES`, a row per piece of every text above `limit` tokens; `start` and `stop` are byte offsets, `n` the text's tokens.

    `doc_kind` tells how natural the text's boundaries are: ``line`` when no stretch without a line break exceeds the limit, ``space`` when none without a line
    break, tab or space does, else ``hard``. `cut` is the boundary at the piece's end (``end``: the text's). Null, empty and fitting texts have no rows; texts of any
    length are taken whole; repeated rows are divided each for itself.
    """
    if not 0 <= 2 * overlap < limit - 16:
        raise ValueError("the overlap must be less than half of the limit")
    long = spread(docs).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            levels = natural_levels(texts, limit)
            numbers = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in _ARROW]
            of, piece = -1, 0
            for t, start, stop, cut in split_all(texts, limit, overlap):
                of, piece = t, piece + 1 if t == of else 0
                for column, value in zip(out, (numbers[t], len(texts[t]), KINDS[levels[t]], piece, start, stop, KINDS[cut]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return long.mapInArrow(run, PIECES)
