"""Scraped pages: the entities they link, their paragraphs, and the page's own entity as the most frequent one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of link targets that don't lead to an article.
EXCLUDED = ("File:", "Wikipedia:", "Category:", "Template:", "Help:", "Special:", "Template_talk:", "Talk:", "User:", "Portal:", "Main_Page", "List_of", "(identifier)")


def link_titles(page: Column) -> Column:
    """The titles that a page's article links lead to, in order: without fragment, underscores and parenthesis."""
    targets = F.regexp_extract_all(page, F.lit('<a [^<>]*href="/wiki/([^"]+)"'), F.lit(1))
    kept = F.filter(targets, lambda t: ~F.exists(F.array(*[F.lit(x) for x in EXCLUDED]), lambda x: F.contains(t, x)))
    return F.transform(kept, lambda t: F.substring_index(F.translate(F.substring_index(t, "#", 1), "_", " "), " (", 1))


def anchors(pages: DataFrame, page_no: str, page: str, titles: DataFrame) -> DataFrame:
    """``(page_no, pos, num)``: the entities a page links, by `titles(title, num)`; unknown titles are left out."""
    links = pages.select(F.col(page_no).alias("page_no"), F.posexplode(link_titles(F.col(page))).alias("pos", "title"))
    return links.join(titles, "title").select("page_no", "pos", "num")


def unescaped(text: Column) -> Column:
    """The five basic character references as characters."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def paragraphs(page: Column) -> Column:
    """The text of the page's paragraphs, a line each: no spans, tags or numbered references."""
    body = F.regexp_extract_all(F.regexp_replace(page, "<span[^>]*>[^<]*</span>", ""), F.lit("<p>(.*?)</p>"), F.lit(1))
    plain = F.transform(body, lambda p: unescaped(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"\[\d+(, ?\d+)*\]", "")))
    return F.array_join(plain, "\n")


def boosted(counts: DataFrame, own: DataFrame) -> DataFrame:
    """``(page_no, num, n)``: entity counts with the page's own entity raised above every other.

    `counts(page_no, num, n)`, `own(page_no, num)`; the own entity has max - own + 1 added, its count being 0 where it is missing.
    """
    most = counts.groupBy("page_no").agg(F.max("n").alias("most"))
    mine = own.join(most, "page_no", "left").select("page_no", "num", (F.coalesce("most", F.lit(0)) + 1).alias("n"))
    others = counts.join(own, ["page_no", "num"], "left_anti")
    return others.select("page_no", "num", "n").unionByName(mine)
