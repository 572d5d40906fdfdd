"""Article records out of pages: one page in, any number of records out.

Every provider is a table of selectors; a site may replace some of them. The
table function parses a page once and emits raw records with the text of their
date and how it is to be read; links, dates and lengths are then settled by
column expressions. A record that can't be read is left out, the page goes on;
a page that can't be parsed gives an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.functions.html import Node, parse
from pressfold.functions.text import SHORTEST_TITLE, absolute_link, cut_summary, dotted_day, iso_day, korean_date, korean_day, trimmed, wall_clock, without_resize

NOW, DROP = "now", "drop"


@dataclass(frozen=True)
class Site:
    """How the records of a page are found, and how their dates are read."""

    items: str
    title: str
    date: str = ""
    date_kind: str = NOW
    date_attribute: str = ""
    on_missing: str = NOW
    summary: str = ""
    image: str = "img"
    image_place: int = 0
    anchor_place: int = 0
    own_link: bool = True
    shortest: int = SHORTEST_TITLE


# Selectors of the providers and sites.
DEFAULT = Site(
    items="article, .post, .entry, .blog-post, .item, [class*='post'], [class*='article'], [class*='entry'], [id*='post'], [id*='article'], [id*='entry']",
    title="h1, h2, h3, h4, .title, .post-title, .entry-title, [class*='title'], [class*='heading'], a[href]",
    summary=".summary, .excerpt, .description, .content, p, [class*='summary'], [class*='excerpt'], [class*='desc']",
    date="time, [datetime], [class*='date'], [class*='time']",
    date_kind="iso_day",
)
TISTORY = Site(items="article, .item_post, .post-item, .entry-content", title="h1, h2, h3, .title, .post-title, a[href]", summary=".summary, .excerpt, .description, p", shortest=1)
MEDIUM = Site(items="div.postArticle[data-post-id]", title="h3", image="img[class*='progressiveMedia-image']", date="time", date_attribute="datetime", date_kind="zoned_or_now", anchor_place=3, own_link=False, shortest=1)
#: Items of a site; of several sites that fit a link the first counts.
SITE_ITEMS = (("toss.tech", "a[class*='css-1qr3mg1'], a[class*='e1sck7qg4']"), ("aws", "article[class*='blog-post']"), ("googleblog", "div[class*='search-result__wrapper']"))
#: Titles of a site; of several that fit the last counts.
SITE_TITLES = (("kakao.com", "h4"), ("toss.tech", "span[class*='typography--h6']"), ("aws", "span[property*='name headline']"), ("googleblog", "h3[class*='search-result__title']"))
MEDIUM_BUCKETS = "div[class*='timebucket']"
GOOGLE_BASE = "https://developers.googleblog.com"


def site_of(blog_link: str) -> Site:
    """The default provider's rules for a blog."""
    site = DEFAULT
    items = next((s for word, s in SITE_ITEMS if word in blog_link), site.items)
    title = next((s for word, s in reversed(SITE_TITLES) if word in blog_link), site.title)
    site = replace(site, items=items, title=title)
    if "d2.naver.com" in blog_link:
        site = replace(site, date="dd", date_kind="dotted_day")
    elif "kakao.com" in blog_link:
        site = replace(site, date="dd[class*='txt_date']", date_kind="dotted_day")
    if "toss.tech" in blog_link:
        return replace(site, date="span[class*='typography--small']", date_kind="korean_day", on_missing=DROP, image_place=1)
    if "aws" in blog_link:
        return replace(site, date="time", date_attribute="datetime", date_kind="zoned", on_missing=DROP)
    if "googleblog" in blog_link:
        return replace(site, date="p[class*='search-result__eyebrow']", date_kind="korean_day", on_missing=DROP)
    return site


def rules(provider: str, blog_link: str | None) -> Site:
    return {"Tistory": TISTORY, "Medium": MEDIUM}.get(provider) or site_of(blog_link or "")


def record(item: Node, site: Site) -> dict | None:
    """The raw fields of one item; None if it is no article."""
    title = item.first(site.title)
    if title is None:
        return None
    text = title.text()
    if len(text) < site.shortest:
        return None
    link = title.get("href") if site.own_link and (title.tag == "a" or site is TISTORY) else ""
    if not link:
        anchors = item.select("a[href]")
        link = anchors[site.anchor_place].get("href") if len(anchors) > site.anchor_place else ""
    if not link:
        return None
    summary = item.first(site.summary) if site.summary else None
    images = item.select(site.image)
    image = images[site.image_place] if len(images) > site.image_place else images[0] if images else None
    date = item.first(site.date) if site.date else None
    if date is None and site.on_missing == DROP:
        return None
    kind = site.date_kind if date is not None else NOW
    return {
        "title": text,
        "link": link,
        "summary": summary.text() if summary is not None else "",
        "thumbnail_image": image.get("src") if image is not None else "",
        "date_text": (date.get(site.date_attribute) if site.date_attribute else date.text()) if date is not None else None,
        "date_kind": kind,
    }


def records(html: str, provider: str, blog_link: str | None) -> Iterator[dict]:
    """The raw records of a page in document order."""
    site = rules(provider, blog_link)
    for item in parse(html).select(site.items):
        try:
            found = record(item, site)
        except Exception as error:  # one broken item does not end the page
            found = dict.fromkeys(_FIELDS) | {"reject": f"{type(error).__name__}: {error}"[:500]}
        if found:
            yield found


def bucket_links(html: str) -> list[str]:
    """Links of the archive's buckets, the first level of a two-level source."""
    return [a.get("href") for bucket in parse(html).select(MEDIUM_BUCKETS) if (a := bucket.first("a")) is not None]


_FIELDS = ["title", "link", "summary", "thumbnail_image", "date_text", "date_kind"]
_COLUMNS = ["corporation_id", "blog_link", "page_url", "provider", "ordinal", *_FIELDS, "reject", "error"]


def _page_rows(b: pd.DataFrame, read: Callable[[str, str, str | None], Iterator[dict]]) -> Iterator[tuple]:
    for corporation, blog, url, provider, html in zip(b["corporation_id"], b["blog_link"], b["page_url"], b["provider"], b["html"], strict=True):
        head = (corporation, blog, url, provider)
        try:
            found = list(read(html or "", provider, blog))
        except Exception as error:  # the page fails, its source is reported
            yield (*head, None, *(None for _ in _FIELDS), None, f"{type(error).__name__}: {error}"[:500])
            continue
        for k, r in enumerate(found):
            yield (*head, k, *(r[c] for c in _FIELDS), r.get("reject"), None)


def raw_records(pages: DataFrame) -> DataFrame:
    """Raw records of pages (corporation_id, blog_link, page_url, provider, html); an error row for a page that can't be parsed, a reject for an item that breaks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(list(_page_rows(b, records)), columns=_COLUMNS)
            yield out.astype({"ordinal": "Int32", "corporation_id": "Int64"})

    schema = "corporation_id bigint, blog_link string, page_url string, provider string, ordinal int, title string, link string, summary string, thumbnail_image string, date_text string, date_kind string, reject string, error string"
    return pages.select("corporation_id", "blog_link", "page_url", "provider", "html").mapInPandas(run, schema)


def published(now: Column) -> Column:
    """The time of a raw record by the kind of its date; null if it can't be read."""
    text, kind = trimmed(F.col("date_text")), F.col("date_kind")
    return (
        F.when(kind == NOW, now)
        .when(kind == "iso_day", iso_day(text))
        .when(kind == "dotted_day", dotted_day(text))
        .when(kind == "korean_day", korean_day(korean_date(text)))
        .when(kind == "zoned", wall_clock(text))
        .when(kind == "zoned_or_now", F.coalesce(wall_clock(text), now))
    )


def settled(raw: DataFrame, now: Column) -> DataFrame:
    """Records with absolute links, cut summaries and times; those without a link or a readable date are left out."""
    link, blog = F.col("link"), F.col("blog_link")
    base = F.when(blog.contains("googleblog"), GOOGLE_BASE).otherwise(blog)
    default = absolute_link(link, base)
    default = F.when(blog.contains("kakao.com"), F.replace(default, F.lit("https://tech.kakao.com/blog"), F.lit("https://tech.kakao.com"))).otherwise(default)
    absolute = (
        F.when(F.col("provider") == "Tistory", absolute_link(link, blog, strip=False)).when(F.col("provider") == "Medium", absolute_link(link, F.col("page_url"), strip=False)).otherwise(default)
    )
    image = F.col("thumbnail_image")
    default_image = F.when(~image.startswith("http") & image.startswith("/"), absolute_link(image, blog)).otherwise(image)
    picture = F.when(F.col("provider") == "Medium", without_resize(image)).when(F.col("provider") == "Tistory", image).otherwise(default_image)
    out = raw.where("error is null and reject is null").withColumns({"link": absolute, "thumbnail_image": picture, "summary": cut_summary(F.col("summary")), "published_at": published(now)})
    return out.where("link is not null and published_at is not null").select("corporation_id", "page_url", "provider", "ordinal", "title", "link", "summary", "thumbnail_image", "published_at")
