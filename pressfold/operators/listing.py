"""Pages of articles with their company and tags, and the numbers that go with a page.

A page is taken at the grain of articles: the best rows are chosen first, by a
top-k that no full sort precedes, and tags are joined to them alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.functions.text import minute_text
from pressfold.operators.predicates import active

LATEST, POPULAR = "latest", "popular"


def order_of(sort: str) -> list[Column]:
    """Exactly ``popular`` sorts by views, anything else by date; nulls and then small ids come last."""
    if sort == POPULAR:
        return [F.desc("view_count"), F.desc("published_at"), F.desc("id")]
    return [F.desc("published_at"), F.desc("created_at"), F.desc("id")]


def check_page(page: int, size: int) -> None:
    if page < 0 or size < 1:
        raise ValueError("a page starts at 0 and has one row or more")


def listed(articles: DataFrame, corporations: DataFrame) -> DataFrame:
    """Active articles with the company's fields; a deleted company's articles stay listed."""
    companies = corporations.select(F.col("id").alias("corporation_id"), F.col("name").alias("corporation_name"), "logo_url")
    return articles.where(active()).join(companies, "corporation_id")


def with_tags(articles: DataFrame, article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Each article with the array of its tags by id and keyword, an empty one if it has none; deleted tags still count."""
    links = article_tags.select(F.col("article_id").alias("id"), "tag_id")
    words = tags.select(F.col("id").alias("tag_id"), "keyword")
    own = links.join(words, "tag_id", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("tag_id").alias("id"), "keyword"))).alias("tags"))
    none = F.array().cast("array<struct<id:bigint,keyword:string>>")
    return articles.join(own, "id", "left").withColumn("tags", F.coalesce("tags", none))


def article_page(articles: DataFrame, corporations: DataFrame, article_tags: DataFrame, tags: DataFrame, *, page: int = 0, size: int = 20, sort: str = LATEST) -> DataFrame:
    """One page of the list: id to published_at as text, the company and the tags, in order."""
    check_page(page, size)
    columns = ("id", "title", "summary", "link", "view_count", "like_count", "thumbnail_image", "reading_time", "published_at", "created_at", "corporation_id", "corporation_name", "logo_url")
    best = listed(articles, corporations).select(*columns).orderBy(*order_of(sort)).offset(page * size).limit(size)
    links = article_tags.join(best.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    company = F.struct(F.col("corporation_id").alias("id"), F.col("corporation_name").alias("name"), "logo_url")
    full = with_tags(best, links, tags).orderBy(*order_of(sort))
    return full.select("id", "title", "summary", "link", "view_count", "like_count", "thumbnail_image", "reading_time", minute_text(F.col("published_at")).alias("published_at"), company.alias("corporation"), "tags")


@dataclass(frozen=True)
class PageNumbers:
    total_elements: int
    total_pages: int
    number: int
    size: int
    has_next: bool
    has_previous: bool


def page_numbers(total: int, page: int, size: int) -> PageNumbers:
    check_page(page, size)
    pages = math.ceil(total / size)
    return PageNumbers(total, pages, page, size, page + 1 < pages, page > 0)


def page_numbers_of(rows: DataFrame, page: int, size: int) -> DataFrame:
    """The same as one row, counted by Spark."""
    check_page(page, size)
    counted = rows.agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("bigint"))
    return counted.select("total_elements", "total_pages", F.lit(page).alias("number"), F.lit(size).alias("size"), (F.lit(page + 1) < F.col("total_pages")).alias("has_next"), F.lit(page > 0).alias("has_previous"))


def page_json(page: DataFrame) -> DataFrame:
    """Each row of a page as one JSON text, nulls included."""
    return page.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
