"""Column expressions on text, links, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut of summaries, shortest title, feed suffixes, phrases of challenge pages.
SUMMARY_LIMIT = 200
SHORTEST_TITLE = 5
FEED_SUFFIXES = ("/feed", "/rss", "/feed.xml", "/rss.xml", "/atom.xml", "/feeds/posts/default", "/feed/", "/rss/", "/index.xml", "/feed.rss")
MEDIUM_SUFFIXES = ("/feed", "/rss")
CHALLENGE_TEXT = ("are you a robot", "human verification", "verify you are human", "captcha")
CHALLENGE_URL = ("robot", "verify")


def minute_text(time: Column) -> Column:
    """``yyyy-MM-dd HH:mm``, null for null; seconds are dropped."""
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def day_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def trimmed(text: Column) -> Column:
    """Without control characters and spaces at the ends, white space within collapsed."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[ \t\n\f\r]+", " ")


def tooltip(time: Column) -> Column:
    """A time in full, as a Korean reader writes it: ``2025. 06. 30. 오후 12:05``."""
    half = F.when(F.hour(time) < 12, "오전").otherwise("오후")
    return F.concat(F.date_format(time, "yyyy. MM. dd. "), half, F.date_format(time, " hh:mm"))


def cut_summary(text: Column) -> Column:
    """Texts over 200 characters cut there, with three dots."""
    return F.when(F.length(text) > SUMMARY_LIMIT, F.concat(F.substring(text, 1, SUMMARY_LIMIT), F.lit("..."))).otherwise(text)


def without_slash(url: Column) -> Column:
    """One slash at the end removed."""
    return F.regexp_replace(url, "/$", "")


def absolute_link(link: Column, base: Column, *, strip: bool = True) -> Column:
    """Links that begin with http as they are, those with / behind the base, others null."""
    prefix = without_slash(base) if strip else base
    return F.when(link.startswith("http"), link).when(link.startswith("/"), F.concat(prefix, link))


def without_resize(url: Column) -> Column:
    return F.regexp_replace(url, r"/resize:fill:\d+:\d+/", "/")


def contains_word(text: Column, word: str) -> Column:
    """Whether the text has the word; false for null."""
    return F.coalesce(text.contains(word), F.lit(False))


def provider_of(blog_link: Column) -> Column:
    """The provider that reads a blog: the first special one that can, else the default."""
    return F.when(contains_word(blog_link, "medium.com"), "Medium").when(contains_word(blog_link, "tistory.com"), "Tistory").otherwise("Default")


def feed_candidates(blog_link: Column) -> Column:
    """Addresses where a blog's feed may be, in order of trial."""
    base = without_slash(blog_link)
    common = F.array(*(F.concat(base, F.lit(s)) for s in FEED_SUFFIXES))
    special = F.array(*(F.concat(base, F.lit(s)) for s in MEDIUM_SUFFIXES))
    return F.when(contains_word(blog_link, "medium.com"), F.concat(special, common)).otherwise(common)


def looks_like_feed(body: Column) -> Column:
    return F.coalesce(trimmed(body).startswith("<?xml") | body.contains("<rss") | body.contains("<feed"), F.lit(False))


def challenge_page(html: Column, url: Column) -> Column:
    """Whether a page asks to prove to be human in place of its content."""
    text, place = F.lower(html), F.lower(url)
    found = [contains_word(text, p) for p in CHALLENGE_TEXT] + [contains_word(place, p) for p in CHALLENGE_URL]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def korean_date(text: Column) -> Column:
    """The first ``yyyy년 M월 d일`` without its spaces; the text itself if there is none."""
    found = F.regexp_extract(text, r"(\d{4}년\s*\d{1,2}월\s*\d{1,2}일)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\s+", "")).otherwise(text)


def korean_day(text: Column) -> Column:
    """Midnight of a Korean date, null if it is none."""
    parts = [F.regexp_extract(text, r"(\d{4})년(\d{1,2})월(\d{1,2})일", k) for k in (1, 2, 3)]
    day = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(parts[0] != "", F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def dotted_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy.MM.dd"))).cast("timestamp_ntz")


def iso_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def wall_clock(text: Column) -> Column:
    """The wall clock of a zoned ISO time, its offset dropped; null for others."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)(\[.+\])?$")
    return F.when(zoned, F.regexp_replace(text, r"(Z|[+-]\d{2}(:?\d{2})?)(\[.+\])?$", "")).try_cast("timestamp_ntz")


def relative_time(time: Column, now: Column) -> Column:
    """How long ago, in the words of the site: minutes, hours, days, weeks, months of 30 and years of 365 days, rounded down."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 1_000_000)
    label = lambda size, word: F.concat(F.floor(seconds / size).cast("string"), F.lit(word))
    minute, hour, day = 60, 3600, 86400
    return (
        F.when(seconds < minute, "방금 전")
        .when(seconds < hour, label(minute, "분 전"))
        .when(seconds < day, label(hour, "시간 전"))
        .when(seconds < 7 * day, label(day, "일 전"))
        .when(seconds < 30 * day, label(7 * day, "주일 전"))
        .when(seconds < 365 * day, label(30 * day, "달 전"))
        .when(seconds.isNotNull(), label(365 * day, "년 전"))
    )


def first_pages(total_pages: Column) -> Column:
    """Page numbers that the home page links: the first five at most, from 0."""
    return F.when(total_pages > 0, F.sequence(F.lit(0), F.least(total_pages, F.lit(5)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def near_pages(page: Column, total_pages: Column) -> Column:
    """Page numbers within two of the current page."""
    low, high = F.greatest(F.lit(0), page - 2).cast("int"), F.least(total_pages - 1, page + 2).cast("int")
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
