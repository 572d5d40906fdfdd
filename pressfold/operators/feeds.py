"""RSS and Atom feeds: candidates, the first body that is a feed, its entries as records."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pressfold.functions.html import parse
from pressfold.functions.text import SHORTEST_TITLE, cut_summary, feed_candidates, looks_like_feed


def candidates(corporations: DataFrame) -> DataFrame:
    """(corporation_id, ordinal, feed_url) of the addresses to try."""
    return corporations.select(F.col("id").alias("corporation_id"), F.posexplode(feed_candidates(F.col("blog_link"))).alias("ordinal", "feed_url"))


def unwrapped(body: Column) -> Column:
    """The feed within a browser's viewer page."""
    inner = F.regexp_extract(body, r"(?s)(<rss.*</rss>)", 1)
    return F.when(body.contains("xml-viewer") & (inner != ""), inner).otherwise(body)


def first_feed(tried: DataFrame, bodies: DataFrame) -> DataFrame:
    """(corporation_id, feed_url, body): of each company the first candidate whose body is a feed with an entry."""
    filled = F.pandas_udf(lambda body: body.map(lambda b: next(entries(b or ""), None) is not None), BooleanType())
    found = tried.join(bodies.select(F.col("url").alias("feed_url"), unwrapped(F.col("body")).alias("body")), "feed_url").where(looks_like_feed(F.col("body")))
    best = found.where(filled("body")).groupBy("corporation_id").agg(F.min_by(F.struct("feed_url", "body"), "ordinal").alias("feed"))
    return best.select("corporation_id", "feed.feed_url", "feed.body")


#: What is trimmed from a title, control characters and spaces.
_BLANK = "".join(map(chr, range(33)))


def _text(node: ET.Element, *names: str) -> str | None:
    for child in node:
        if child.tag.rpartition("}")[2] in names:
            return "".join(child.itertext())
    return None


def _link(node: ET.Element) -> str | None:
    for child in node:
        if child.tag.rpartition("}")[2] == "link":
            if child.get("href") and child.get("rel", "alternate") == "alternate":
                return child.get("href")
            if child.text and child.text.strip():
                return child.text
    return None


def instant(text: str | None) -> datetime | None:
    """A feed's date as an instant in UTC without zone."""
    if not text or not text.strip():
        return None
    text = text.strip()
    try:
        found = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        try:
            found = datetime.fromisoformat(text)
        except ValueError:
            return None
    if found.tzinfo:
        found = found.astimezone(timezone.utc).replace(tzinfo=None)
    return found


def entries(body: str) -> Iterator[dict]:
    """Entries of a feed with a title and a link; an unreadable feed has none."""
    try:
        root = ET.fromstring(re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;", body.strip()))
    except ET.ParseError:
        return
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        title, link = _text(node, "title"), _link(node)
        if not title or len(title.strip(_BLANK)) < SHORTEST_TITLE or not link or not link.strip():
            continue
        described = _text(node, "description", "summary")
        yield {"title": title.strip(_BLANK), "link": link, "summary": parse(described).text() if described else "", "instant": instant(_text(node, "pubDate", "published", "date")) or instant(_text(node, "updated"))}


def feed_records(feeds: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Records of the feeds: times in the wall clock of ``zone``, ``now`` for those without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, u, k, e["title"], e["link"], e["summary"], e["instant"]) for c, u, body in zip(b["corporation_id"], b["feed_url"], b["body"], strict=True) for k, e in enumerate(entries(body or ""))]
            out = pd.DataFrame(rows, columns=["corporation_id", "feed_url", "ordinal", "title", "link", "summary", "instant"])
            yield out.assign(instant=pd.to_datetime(out["instant"]))

    raw = feeds.select("corporation_id", "feed_url", "body").mapInPandas(run, "corporation_id bigint, feed_url string, ordinal int, title string, link string, summary string, instant timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("instant"))
    return raw.select("corporation_id", F.col("feed_url").alias("page_url"), F.lit("Default").alias("provider"), "ordinal", "title", "link", cut_summary(F.col("summary")).alias("summary"), F.lit(None).cast("string").alias("thumbnail_image"), F.coalesce(local, now).alias("published_at"))
