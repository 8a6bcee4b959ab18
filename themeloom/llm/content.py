"""Main content of web pages: text-to-tag ratios, smoothed, and site templates.

The page's HTML goes through the standard library's streaming parser. Its events give every block its text, its number of tags, its place in the
structure; the lines of the visible text are matched with the blocks. The text-to-tag ratio of the lines is smoothed with a Gaussian kernel, and lines
above a threshold taken from the page's own spread form the content regions.

Ratios alone can't tell a sentence that a site writes into every article from one of the article, nor a short list line from a navigation line. So
each line also has keys - its text, its shape (digits and capitalised words masked), its first and last words, its separators - and all pages of all sites
vote: a key that stands on a considerable part of a site's pages, or of all pages, is the site's. Shares are lower confidence bounds, so small sites need more
than chance repetition. A line is part of the article when it is the title or a heading, or in a content region and without a key of its site.

The vote is one shuffle of hashed keys, combined before it. Pages themselves are never moved; their features, flags and hashed keys, are only where the template keys are too many to be broadcast. Only the shares' thresholds bound the sets of template keys: a site has at most
(keys of a page) / share of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..session import spread as dealt_out

# fixed values: elements that part text into blocks, elements whose content isn't an article's, headings
_BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "br"))
_ASIDE = frozenset(("nav", "aside", "footer", "head", "script", "style"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
PLAIN, HEADING, ASIDE = 0, 1, 2


class Blocks(HTMLParser):
    """Blocks of a page as ``[text, tags, kind]``, in order; unclosed and stray tags don't matter."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[str] = []
        self.aside = self.bold = self.heading = 0
        self._new()

    def _new(self) -> None:
        self.text: list[str] = []
        self.tags = 0
        self.strong = self.weak = self.headed = self.hidden = False

    def _end(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            kind = ASIDE if self.hidden else HEADING if self.headed or (self.strong and not self.weak) else PLAIN
            self.blocks.append([text, self.tags, kind])
            self._new()
        else:
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end()
        self.tags += 1
        if tag in _VOID:
            return
        self.open.append(tag)
        self.aside += tag in _ASIDE
        self.bold += tag in ("b", "strong")
        self.heading += tag in _HEADINGS

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end()
        if tag not in self.open:
            return
        while True:
            last = self.open.pop()
            self.aside -= last in _ASIDE
            self.bold -= last in ("b", "strong")
            self.heading -= last in _HEADINGS
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not data.isspace():
            self.headed |= self.heading > 0
            self.hidden |= self.aside > 0
            if self.bold:
                self.strong = True
            else:
                self.weak = True

    def read(self, page: str) -> list[list]:
        for start in range(0, len(page), 1 << 16):
            self.feed(page[start : start + (1 << 16)])
        self.close()
        self._end()
        return self.blocks


def aligned(lines: list[str], blocks: list[list]) -> list[list | None]:
    """The block of each line: the next one with the same text, in order; None where there is none."""
    places: dict[str, list[int]] = {}
    for i in range(len(blocks) - 1, -1, -1):
        places.setdefault(blocks[i][0], []).append(i)
    out: list[list | None] = []
    last = -1
    for line in lines:
        at = places.get(" ".join(line.split()))
        while at and at[-1] <= last:
            at.pop()
        if at:
            last = at.pop()
            out.append(blocks[last])
        else:
            out.append(None)
    return out


def smoothed_ratios(lengths: np.ndarray, tags: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Text-to-tag ratio per line, smoothed with a Gaussian kernel; the ends are padded with themselves."""
    ratio = lengths / np.maximum(tags, 1)
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratio, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


_DIGITS = re.compile(r"\d+")
_DOMAIN = re.compile(r"(?:https?://)?[A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)+(?:/\S*)?")
_END = re.compile(r"[.!?。！？][\"')\]»”’]*(?:\s*\[[^\[\]]*\]?)*$")
_SEPARATOR = re.compile(r"(?<=\s)[|•·/>»:–-](?=\s)|\s{2,}")


def is_sentence(line: str) -> bool:
    """Running text: at least four words and an end mark, which isn't an ellipsis; a reference may follow."""
    return len(line.split()) >= 4 and bool(_END.search(line)) and not line.endswith(("...", "…"))


def masked_word(w: str) -> str:
    """9 for numbers and codes, X for a word with a capital, else the word with its digits masked."""
    if w.isalpha() or (w.isascii() and not _DIGITS.search(w)):
        return "X" if w[0].isupper() else w
    return "9" if any(c.isdigit() for c in w) and not any(c.islower() for c in w) else "X" if w[0].isupper() else _DIGITS.sub("9", w)


def line_keys(line: str, sentence: bool) -> list[str]:
    """What a line may share with lines of other pages. Running text has only its text and shape; other lines also the words and marks around what varies."""
    words = line.split()
    words = [_DOMAIN.sub("U", w) if "." in w else w for w in words]
    masked = [masked_word(w) for w in words]
    shape = [w for i, w in enumerate(masked) if w != "X" or not i or masked[i - 1] != "X"]
    keys = ["t" + line]
    if shape != ["X"]:
        keys.append("m" + " ".join(shape))
    if sentence or not words:
        return keys
    if len(words) > 2:
        head, tail = [_DIGITS.sub("9", w) for w in words[:2]], [_DIGITS.sub("9", w) for w in words[-2:]]
        if any(w[0].islower() for w in head):
            keys.append("p" + " ".join(head))
        if any(w[0].islower() or not w[0].isalnum() for w in tail):
            keys.append("s" + " ".join(tail))
    if len(words) > 1 and words[0].endswith(":"):
        keys.append("c" + words[0])
    if marks := _SEPARATOR.findall(line.strip()):
        mark = max(sorted(set(marks)), key=marks.count)
        keys.append("b" + (mark.strip() or "  "))
    return keys


FEATURES = "page_no bigint, site string, title string, lines int, kinds array<tinyint>, sentences array<boolean>, regions array<boolean>, titles array<boolean>, keys array<array<bigint>>, marked_up boolean"
_ARROW = pa.schema([("page_no", pa.int64()), ("site", pa.string()), ("title", pa.string()), ("lines", pa.int32()), ("kinds", pa.list_(pa.int8())), ("sentences", pa.list_(pa.bool_())), ("regions", pa.list_(pa.bool_())), ("titles", pa.list_(pa.bool_())), ("keys", pa.list_(pa.list_(pa.int64()))), ("marked_up", pa.bool_())])


def page_features(title: str | None, text: str, page: str | None, spread: float) -> tuple[list, list, list, list, list]:
    """``(kinds, sentences, regions, titles, keys)`` of the lines of `text`; without `page` every line counts as a plain block of one tag."""
    lines = text.split("\n")
    blocks = aligned(lines, Blocks().read(page)) if page else [None] * len(lines)
    lengths = np.array([len(x) for x in lines], float)
    tags = np.array([b[1] if b else 1 for b in blocks], float)
    score = smoothed_ratios(lengths, tags)
    regions = (score >= spread * score.std()).tolist()
    kinds = [b[2] if b else PLAIN for b in blocks]
    sentences = [is_sentence(x) for x in lines]
    name = " ".join((title or "").replace("_", " ").split()).casefold()
    titles = [bool(name) and " ".join(x.split()).casefold() == name for x in lines]
    keys = [[xxhash.xxh64_intdigest(k) - (1 << 63) for k in line_keys(x, s)] if x.strip() else [] for x, s in zip(lines, sentences, strict=True)]
    return kinds, sentences, regions, titles, keys


def article_lines(kinds: list, sentences: list, regions: list, titles: list, keys: list, template: frozenset, common: frozenset, marked_up: bool) -> list[bool]:
    """Which lines are the article's, given the keys that are the site's and those of all sites.

    Without markup headings can't be told by their element: a short line is taken for one when it stands within the article and running text or a list of the
    article follows. Of several lines that equal the title, the heading, else the last before the first running text, is the title.
    """
    own = [not any(k in template or k in common for k in ks) for ks in keys]
    body = [o and r and k != ASIDE and bool(ks) for o, r, k, ks in zip(own, regions, kinds, keys, strict=True)]
    out = [b or (k == HEADING and bool(ks)) for b, k, ks in zip(body, kinds, keys, strict=True)]
    if not any(k == HEADING for k in kinds):
        running = [i for i, (b, s) in enumerate(zip(body, sentences, strict=True)) if b and s]
        first = running[0] if running else len(kinds)
        named = [i for i, t in enumerate(titles) if t and i < first]
        start = named[-1] if named else first
        for i in range(len(out)):
            if i < start:
                out[i] = False
            elif not marked_up and not sentences[i] and i > start and i + 1 < len(out) and body[i + 1] and keys[i] and len(keys[i]) <= 2:
                out[i] = True
        if named:
            out[start] = True
    return out


def _share(count, n, z: float = 1.64):
    """Lower confidence bound (Wilson) of a share."""
    p = count / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def features(pages: DataFrame, page_no: str, site: str, title: str, text: str, page: str, spread: float = 0.1) -> DataFrame:
    """`FEATURES`, a row per page with a text."""
    picked = dealt_out(pages).select(F.col(page_no).cast("bigint").alias("n"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("s"), F.col(title).cast("string").alias("h"), F.col(text).cast("string").alias("t"), F.col(page).cast("string").alias("p")).where("length(t) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000).to_pydict()
                out: list[list] = [[] for _ in _ARROW]
                for n, s, h, t, p in zip(*part.values(), strict=True):
                    found = page_features(h, t, p, spread)
                    for column, value in zip(out, (n, s, h, len(found[0]), *found, bool(p)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return picked.mapInArrow(run, FEATURES)


def template_keys(found: DataFrame, site_share: float = 0.05, all_share: float = 0.03) -> DataFrame:
    """``(site, key)`` of the keys that are on a considerable part of the pages of a site, or with site null of all pages.

    Pages count once per site and title, whatever the number of their states. Lines that are headings by their markup don't vote.
    """
    votes = F.array_distinct(F.flatten(F.transform(F.arrays_zip("keys", "kinds"), lambda x: F.when(x["kinds"] != HEADING, x["keys"]).otherwise(F.array().cast("array<bigint>")))))
    one = found.select("site", F.coalesce("title", F.concat(F.lit("\n"), "page_no")).alias("title"), "page_no", votes.alias("keys"))
    one = one.groupBy("site", "title").agg(F.min_by("keys", "page_no").alias("keys"))
    one = materialise(one)
    pages = one.groupBy("site").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = materialise(one.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("c")))
    of_site = counts.where("c > 1").join(pages, "site").where(_share(F.col("c"), F.col("n")) >= site_share).select("site", "key")
    total = float(one.count() or 1)  # a key of all sites may stand once on each
    of_all = counts.groupBy("key").agg(F.sum("c").alias("c")).where((F.col("c") > 1) & (_share(F.col("c"), F.lit(total)) >= all_share)).select(F.lit(None).cast("string").alias("site"), "key")
    return of_site.unionByName(of_all)


def other_lines(pages: DataFrame, page_no: str, site: str, title: str, text: str, page: str, broadcast_keys: int = 2_000_000, hot_share: float = 0.005) -> DataFrame:
    """``(page_no, line_no)`` of every line of `text` (0-based, split at line feeds) that isn't part of the article.

    Null and empty texts have no lines. A line without any character but spaces is no part of an article. A null or empty `page` leaves the text to
    speak for itself; a null site is a site of its own kind, a null title is none. Repeated rows are judged each for itself.
    """
    found = materialise(features(pages, page_no, site, title, text, page))
    keys = materialise(template_keys(found))
    per_site = keys.where("site is not null").groupBy("site").agg(F.collect_set("key").alias("own"))  # at most (keys of a page) / site_share each
    everywhere = [r.key for r in keys.where("site is null").select("key").collect()]  # at most (keys of a page) / all_share
    if keys.count() <= broadcast_keys:
        joined = found.join(F.broadcast(per_site), "site", "left")
    else:  # sites with a considerable part of the pages are few and meet their keys by broadcast, so no site is hot in the other join
        sites = found.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        hot = materialise(sites.join(sites.agg(F.sum("n").alias("all")).where("all > 0"), F.col("n") >= F.col("all") * hot_share).select("site"))
        far, near = per_site.join(F.broadcast(hot), "site", "left_anti"), per_site.join(F.broadcast(hot), "site")
        joined = found.join(F.broadcast(hot), "site", "left_anti").join(far, "site", "left").unionByName(found.join(F.broadcast(hot), "site", "left_semi").join(F.broadcast(near), "site", "left"))
    mine = F.array_intersect(F.array_distinct(F.flatten("keys")), F.coalesce("own", F.array().cast("array<bigint>")))
    shared = found.sparkSession.sparkContext.broadcast(frozenset(everywhere))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            numbers, places = [], []
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000).to_pydict()
                for n, kinds, sentences, regions, titles, ks, own, marked in zip(*part.values(), strict=True):
                    kept = article_lines(kinds, sentences, regions, titles, ks, frozenset(own), common, marked)
                    gone = [i for i, k in enumerate(kept) if not k]
                    numbers += [n] * len(gone)
                    places += gone
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=["page_no", "line_no"])

    return joined.select("page_no", "kinds", "sentences", "regions", "titles", "keys", mine.alias("own"), "marked_up").mapInArrow(run, "page_no bigint, line_no bigint")
