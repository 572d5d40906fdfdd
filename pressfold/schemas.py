"""Explicit schemas, as DDL, of the catalogue's tables and of the records derived from them."""

from __future__ import annotations

_AUDIT = "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ"


CORPORATION = f"id BIGINT, name STRING, home_link STRING, blog_link STRING, crew_link STRING, logo_url STRING, {_AUDIT}"
INDUSTRY = "id INT, name STRING"
CORPORATION_INDUSTRY = "id BIGINT, corporation_id BIGINT, industry_id INT, created_at TIMESTAMP_NTZ"
ARTICLE = (
    "id BIGINT, corporation_id BIGINT, title STRING, summary STRING, link STRING, view_count INT, like_count INT, "
    f"thumbnail_image STRING, reading_time INT, published_at TIMESTAMP_NTZ, {_AUDIT}"
)
TAG = f"id BIGINT, keyword STRING, request_count INT, {_AUDIT}"
ARTICLE_TAG = f"id BIGINT, article_id BIGINT, tag_id BIGINT, {_AUDIT}"
CRAWL_RESULT = "corporation_id BIGINT, corporation_name STRING, success BOOLEAN, error_message STRING, crawled_at TIMESTAMP_NTZ, total_articles INT, new_articles INT"
PAGE = "url STRING, html STRING, error STRING, fetched_at TIMESTAMP_NTZ"

# Limits of the columns.
LIMITS = {"corporation.name": 100, "industry.name": 50, "tag.keyword": 100, "article.title": 200, "article.link": 500}
