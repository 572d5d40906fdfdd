"""Queries over the catalogue, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.functions import text as X
from pressfold.operators import corporations as C
from pressfold.operators import extract, feeds, ingest, listing, stats
from pressfold.operators import predicates as P
from pressfold.sources.tables import table

#: The time that queries take as now.
NOW = "2025-06-30 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _flat(page: DataFrame) -> DataFrame:
    """The nested page as plain columns."""
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"].cast("string"), F.coalesce(t["keyword"], F.lit("")))), "|")
    return page.select("id", "title", "link", "view_count", "like_count", F.col("reading_time").cast("string").alias("reading_time"), "published_at", F.col("corporation.id").alias("corporation_id"), F.col("corporation.name").alias("corporation_name"), tags.alias("tags"))


def _page(spark: SparkSession, folder: str, **how: object) -> DataFrame:
    tables = (table(spark, folder, n) for n in ("article", "corporation", "article_tag", "tag"))
    return _flat(listing.article_page(*tables, **how))


def _page_sql(order: str, offset: int, size: int) -> str:
    return f"""
WITH best AS (
  SELECT a.*, c.name AS corporation_name FROM article a JOIN corporation c ON a.corporation_id = c.id
  WHERE a.deleted_at IS NULL ORDER BY {order} LIMIT {size} OFFSET {offset}
), words AS (
  SELECT l.article_id, string_agg(l.tag_id || ':' || coalesce(t.keyword, ''), '|' ORDER BY l.tag_id, t.keyword) AS tags
  FROM article_tag l LEFT JOIN tag t ON l.tag_id = t.id WHERE l.article_id IN (SELECT id FROM best) GROUP BY 1
)
SELECT b.id, b.title, b.link, b.view_count, b.like_count, b.reading_time::VARCHAR AS reading_time, strftime(b.published_at, '%Y-%m-%d %H:%M') AS published_at,
  b.corporation_id, b.corporation_name, coalesce(w.tags, '') AS tags
FROM best b LEFT JOIN words w ON b.id = w.article_id"""


_LATEST = "a.published_at DESC NULLS LAST, a.created_at DESC NULLS LAST, a.id DESC"
_POPULAR = "a.view_count DESC NULLS LAST, a.published_at DESC NULLS LAST, a.id DESC"


@query(_page_sql(_LATEST, 40, 20))
def article_latest_page(spark: SparkSession, folder: str) -> DataFrame:
    return _page(spark, folder, page=2, size=20)


@query(_page_sql(_POPULAR, 0, 20))
def article_popular_page(spark: SparkSession, folder: str) -> DataFrame:
    return _page(spark, folder, sort="popular")


@query(_page_sql(_LATEST, 2_000_000_000, 20))
def article_page_past_end(spark: SparkSession, folder: str) -> DataFrame:
    return _page(spark, folder, page=100_000_000, size=20)


@query("""
SELECT count(*) AS total_elements, ceil(count(*) / 20.0)::BIGINT AS total_pages, 3 AS number, 20 AS size, 4 < ceil(count(*) / 20.0) AS has_next, true AS has_previous
FROM article a JOIN corporation c ON a.corporation_id = c.id WHERE a.deleted_at IS NULL""")
def article_page_meta(spark: SparkSession, folder: str) -> DataFrame:
    return listing.page_numbers_of(listing.listed(table(spark, folder, "article"), table(spark, folder, "corporation")), 3, 20)


@query("""
WITH words AS (
  SELECT l.article_id, string_agg(l.tag_id || ':' || coalesce(t.keyword, ''), '|' ORDER BY l.tag_id, t.keyword) AS tags
  FROM article_tag l LEFT JOIN tag t ON l.tag_id = t.id GROUP BY 1)
SELECT a.id, c.name AS corporation_name, coalesce(w.tags, '') AS tags
FROM article a JOIN corporation c ON a.corporation_id = c.id LEFT JOIN words w ON a.id = w.article_id WHERE a.deleted_at IS NULL""")
def article_detail_tags(spark: SparkSession, folder: str) -> DataFrame:
    articles = listing.listed(table(spark, folder, "article"), table(spark, folder, "corporation")).select("id", "corporation_name")
    full = listing.with_tags(articles, table(spark, folder, "article_tag"), table(spark, folder, "tag"))
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"].cast("string"), F.coalesce(t["keyword"], F.lit("")))), "|")
    return full.select("id", "corporation_name", tags.alias("tags"))


@query("SELECT id, title FROM article a WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM article_tag l WHERE l.article_id = a.id)")
def article_without_tags(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "article_tag").select(F.col("article_id").alias("id"))
    return table(spark, folder, "article").where(P.active()).join(links, "id", "left_anti").select("id", "title")


@query("SELECT id, name FROM corporation WHERE deleted_at IS NULL")
def corp_active(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corporation").where(P.active()).select("id", "name")


def _company_page(spark: SparkSession, folder: str, **how: object) -> DataFrame:
    page = C.company_page(*(table(spark, folder, n) for n in ("corporation", "corporation_industry", "industry")), **how)
    return page.select("id", "name", *C.LINKS, F.array_join("industries", "|").alias("industries"), X.day_text(F.col("created_at")).alias("created_on"))


def _company_sql(condition: str, offset: int) -> str:
    return f"""
WITH best AS (SELECT * FROM corporation WHERE deleted_at IS NULL AND {condition} ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 10 OFFSET {offset}),
names AS (SELECT l.corporation_id, string_agg(i.name, '|' ORDER BY i.name) AS industries FROM corporation_industry l JOIN industry i ON l.industry_id = i.id GROUP BY 1)
SELECT b.id, b.name, home_link, blog_link, crew_link, logo_url, coalesce(n.industries, '') AS industries, strftime(b.created_at, '%Y-%m-%d') AS created_on
FROM best b LEFT JOIN names n ON b.id = n.corporation_id"""


@query(_company_sql("true", 20))
def corp_page(spark: SparkSession, folder: str) -> DataFrame:
    return _company_page(spark, folder, page=2)


@query(_company_sql("name LIKE '%Labs%'", 0))
def corp_search(spark: SparkSession, folder: str) -> DataFrame:
    return _company_page(spark, folder, search="Labs")


@query(_company_sql("name LIKE '%K%i_%s%'", 0))
def corp_search_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return _company_page(spark, folder, search="K%i_%s")


@query("SELECT id, name, blog_link FROM corporation WHERE id = 7 AND deleted_at IS NULL")
def corp_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return C.find_active(table(spark, folder, "corporation"), 7).select("id", "name", "blog_link")


@query("SELECT i.name, EXISTS (SELECT 1 FROM corporation c WHERE c.name = i.name AND c.deleted_at IS NULL) AS taken FROM (SELECT DISTINCT name FROM corporation) i")
def corp_exists_name(spark: SparkSession, folder: str) -> DataFrame:
    companies = table(spark, folder, "corporation")
    taken = companies.where(P.active()).select("name").distinct().withColumn("taken", F.lit(True))
    return companies.select("name").distinct().join(taken, "name", "left").select("name", F.coalesce("taken", F.lit(False)).alias("taken"))


@query("""
SELECT c.id, coalesce(string_agg(i.name, '|' ORDER BY i.name), '') AS industries
FROM corporation c LEFT JOIN corporation_industry l ON l.corporation_id = c.id LEFT JOIN industry i ON l.industry_id = i.id GROUP BY c.id""")
def corp_industries(spark: SparkSession, folder: str) -> DataFrame:
    full = C.with_industries(table(spark, folder, "corporation").select("id"), table(spark, folder, "corporation_industry"), table(spark, folder, "industry"))
    return full.select("id", F.array_join("industries", "|").alias("industries"))


@query("SELECT id, name FROM industry WHERE id IN (3, 5, 999)")
def industry_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    return P.by_ids(table(spark, folder, "industry"), [3, 5, 999]).select("id", "name")


@query("SELECT id, name FROM industry WHERE name = '게임'")
def industry_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "industry").where(F.col("name") == "게임").select("id", "name")


@query("SELECT id, title, deleted_at IS NOT NULL AS deleted FROM article WHERE id = 100")
def article_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """By id, deleted or not."""
    return table(spark, folder, "article").where(F.col("id") == 100).limit(1).select("id", "title", F.col("deleted_at").isNotNull().alias("deleted"))


@query("SELECT DISTINCT a.id, a.link FROM article a JOIN crawled_article c ON a.link = c.link WHERE a.deleted_at IS NULL")
def link_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Active articles with the links of incoming records, of all batches."""
    wanted = table(spark, folder, "crawled_article").select("link")
    return table(spark, folder, "article").where(P.active()).join(wanted, "link", "left_semi").select("id", "link")


@query("SELECT id, blog_link FROM corporation WHERE deleted_at IS NULL AND blog_link IS NOT NULL AND blog_link <> ''")
def corp_crawlable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corporation").where(P.crawlable()).select("id", "blog_link")


@query("SELECT id, name FROM corporation WHERE deleted_at IS NULL AND (blog_link IS NULL OR trim(blog_link) = '')")
def corp_blank_link(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corporation").where(P.active() & P.blank_link()).select("id", "name")


@query("SELECT id, corporation_id, published_at FROM article WHERE corporation_id = 7 AND deleted_at IS NULL")
def corp_articles_active(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article").where((F.col("corporation_id") == 7) & P.active())
    return rows.orderBy(F.desc("published_at"), F.desc("id")).select("id", "corporation_id", "published_at")


@query("SELECT corporation_id, count(*) AS articles FROM article GROUP BY 1")
def corp_articles_all_count(spark: SparkSession, folder: str) -> DataFrame:
    return stats.articles_by_company(table(spark, folder, "article"))


@query("SELECT corporation_id, count(*) AS new_articles FROM article WHERE created_at >= TIMESTAMP '2025-01-01' GROUP BY 1")
def new_articles_since(spark: SparkSession, folder: str) -> DataFrame:
    return stats.new_articles(table(spark, folder, "article"), F.lit("2025-01-01").cast("timestamp_ntz"))


@query(f"""
WITH sources AS (SELECT id FROM corporation WHERE deleted_at IS NULL AND blog_link IS NOT NULL AND blog_link <> '')
SELECT (SELECT count(*) FROM sources) AS total_corporations,
  (SELECT count(*) FROM article WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND corporation_id IN (SELECT id FROM sources)) AS total_new_articles, TIMESTAMP '{NOW}' AS last_crawled_at""")
def crawl_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.crawl_stats(table(spark, folder, "corporation"), table(spark, folder, "article"), _now())


@query("""
SELECT count(*) AS sources, count(*) FILTER (coalesce(success, false)) AS successes, count(*) FILTER (NOT coalesce(success, false)) AS failures,
  coalesce(sum(new_articles) FILTER (success), 0)::BIGINT AS new_articles FROM crawl_result""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_summary(table(spark, folder, "crawl_result"))


@query("SELECT corporation_id::VARCHAR AS corporation_id, coalesce(corporation_name, 'Unknown') AS corporation_name, error_message, crawled_at FROM crawl_result WHERE NOT coalesce(success, false)")
def run_failures(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_failures(table(spark, folder, "crawl_result")).withColumn("corporation_id", F.col("corporation_id").cast("string"))


@query("""
SELECT id, CASE WHEN blog_link LIKE '%medium.com%' THEN 'Medium' WHEN blog_link LIKE '%tistory.com%' THEN 'Tistory' ELSE 'Default' END AS provider,
  coalesce(blog_link LIKE '%devlog%', false) AS has_word FROM corporation""")
def provider_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    link = F.col("blog_link")
    return table(spark, folder, "corporation").select("id", X.provider_of(link).alias("provider"), X.contains_word(link, "devlog").alias("has_word"))


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawled_article")
    return rows.select("id", "corporation_id", "title", "link", F.col("batch_no").cast("string").alias("page_url"), F.col("id").alias("ordinal"))


_FIRST = "SELECT * FROM (SELECT id, corporation_id, link, row_number() OVER (PARTITION BY link ORDER BY corporation_id, batch_no::VARCHAR, id) AS k FROM crawled_article) WHERE k = 1"


@query(f"SELECT id, corporation_id, link FROM ({_FIRST})")
def link_dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.first_by_link(_incoming(spark, folder)).select("id", "corporation_id", "link")


@query(f"SELECT id, corporation_id, link FROM ({_FIRST}) f WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.link = f.link AND a.deleted_at IS NULL)")
def link_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    new = ingest.unknown_links(ingest.first_by_link(_incoming(spark, folder)), table(spark, folder, "article"))
    return new.select("id", "corporation_id", "link")


@query("SELECT count(*) AS links, count(DISTINCT link) AS distinct_links FROM article WHERE deleted_at IS NULL")
def link_unique_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article").where(P.active()).agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM documents")
def summary_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.cut_summary(F.col("text")).alias("summary"))


@query(f"""
SELECT id, CASE WHEN s < 60 THEN '방금 전' WHEN s < 3600 THEN s // 60 || '분 전' WHEN s < 86400 THEN s // 3600 || '시간 전' WHEN s < 604800 THEN s // 86400 || '일 전'
  WHEN s < 2592000 THEN s // 604800 || '주일 전' WHEN s < 31536000 THEN s // 2592000 || '달 전' ELSE s // 31536000 || '년 전' END AS age
FROM (SELECT id, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at)) / 1000000.0)::BIGINT AS s FROM article WHERE published_at IS NOT NULL)""")
def relative_time(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article").where("published_at is not null").select("id", X.relative_time(F.col("published_at"), _now()).alias("age"))


@query("SELECT id, strftime(published_at, '%Y-%m-%d %H:%M') AS published_minute, strftime(created_at, '%Y-%m-%d') AS created_day FROM article")
def date_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article").select("id", X.minute_text(F.col("published_at")).alias("published_minute"), X.day_text(F.col("created_at")).alias("created_day"))


@query("""
SELECT id, CASE WHEN p LIKE 'http%' THEN p WHEN p LIKE '/%' THEN regexp_replace(blog_link, '/$', '') || p END AS link
FROM (SELECT id, blog_link, CASE id % 3 WHEN 0 THEN logo_url WHEN 1 THEN '/posts/' || id ELSE 'posts/' || id END AS p FROM corporation)""")
def url_absolutise(spark: SparkSession, folder: str) -> DataFrame:
    place = F.when(F.col("id") % 3 == 0, F.col("logo_url")).when(F.col("id") % 3 == 1, F.concat(F.lit("/posts/"), F.col("id"))).otherwise(F.concat(F.lit("posts/"), F.col("id")))
    return table(spark, folder, "corporation").select("id", X.absolute_link(place, F.col("blog_link")).alias("link"))


@query("""
SELECT id AS corporation_id, k - 1 AS ordinal, regexp_replace(blog_link, '/$', '') || s[k] AS feed_url FROM (
  SELECT id, blog_link, unnest(range(1, len(s) + 1)) AS k, s FROM (
    SELECT id, blog_link, list_concat(CASE WHEN blog_link LIKE '%medium.com%' THEN ['/feed', '/rss'] ELSE [] END,
      ['/feed', '/rss', '/feed.xml', '/rss.xml', '/atom.xml', '/feeds/posts/default', '/feed/', '/rss/', '/index.xml', '/feed.rss']) AS s
    FROM corporation WHERE blog_link IS NOT NULL))""")
def feed_url_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.candidates(table(spark, folder, "corporation").where("blog_link is not null"))


@query("""
SELECT doc_id FROM (SELECT doc_id, source, text || CASE doc_id % 9 WHEN 0 THEN ' Are you a ROBOT?' WHEN 1 THEN ' robots are here' WHEN 2 THEN '<p>Captcha</p>' ELSE '' END AS text FROM documents) WHERE lower(text) LIKE '%are you a robot%' OR lower(text) LIKE '%human verification%' OR lower(text) LIKE '%verify you are human%'
  OR lower(text) LIKE '%captcha%' OR lower(source) LIKE '%robot%' OR lower(source) LIKE '%verify%'""")
def challenge_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the demand added to some, as pages."""
    kind = F.col("doc_id") % 9
    added = F.when(kind == 0, " Are you a ROBOT?").when(kind == 1, " robots are here").when(kind == 2, "<p>Captcha</p>").otherwise("")
    return table(spark, folder, "documents").withColumn("text", F.concat("text", added)).where(X.challenge_page(F.col("text"), F.col("source"))).select("doc_id")


@query("SELECT doc_id, coalesce(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)) LIKE '<?xml%' OR text LIKE '%<rss%' OR text LIKE '%<feed%', false) AS feed FROM documents")
def feed_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.looks_like_feed(F.col("text")).alias("feed"))


@query("SELECT id, title FROM crawled_article WHERE length(title) >= 5")
def title_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawled_article").where(F.length("title") >= X.SHORTEST_TITLE).select("id", "title")


@query("""
SELECT corporation_id, n, array_to_string(range(greatest(0, corporation_id % 9 - 2), least(n - 1, corporation_id % 9 + 2) + 1), ',') AS near, array_to_string(range(0, least(n, 5)), ',') AS first
FROM (SELECT corporation_id, ceil(count(*) / 20.0)::BIGINT AS n FROM article WHERE corporation_id IS NOT NULL GROUP BY 1)""")
def page_window(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "article").where("corporation_id is not null").groupBy("corporation_id").agg(F.ceil(F.count("*") / 20).alias("n"))
    join = lambda a: F.array_join(a.cast("array<string>"), ",")
    return pages.select("corporation_id", "n", join(X.near_pages(F.col("corporation_id") % 9, F.col("n"))).alias("near"), join(X.first_pages(F.col("n"))).alias("first"))


@query("SELECT name, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, count(*) FILTER (deleted_at IS NULL) AS active FROM corporation GROUP BY name")
def soft_delete_reuse_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corporation").groupBy("name").agg(F.count_if(~P.active()).alias("deleted"), F.count_if(P.active()).alias("active"))


@query("""
SELECT corporation_id, industry_id FROM corporation_industry WHERE corporation_id <> 7
UNION ALL SELECT 7 AS corporation_id, id AS industry_id FROM industry WHERE id IN (1, 4, 999)""")
def bridge_replace(spark: SparkSession, folder: str) -> DataFrame:
    new = C.linked(table(spark, folder, "corporation_industry"), table(spark, folder, "industry"), 7, [1, 4, 999], datetime.fromisoformat(NOW))
    return new.select("corporation_id", "industry_id")


@query("SELECT count(*) AS articles, avg(CASE WHEN trim(summary) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS with_summary, avg(CASE WHEN published_at IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS with_date FROM article")
def quality_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return stats.quality(table(spark, folder, "article"))


@query("SELECT 'article' AS name, count(*) AS n FROM article UNION ALL SELECT 'article_tag', count(*) FROM article_tag UNION ALL SELECT 'tag', count(*) FROM tag")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name in ("article", "article_tag", "tag"):
        one = table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT to_json({id: a.id, title: a.title, company: {id: c.id, name: c.name}}) AS json FROM article a JOIN corporation c ON a.corporation_id = c.id WHERE a.deleted_at IS NULL""")
def article_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = listing.listed(table(spark, folder, "article"), table(spark, folder, "corporation"))
    body = F.struct("id", "title", F.struct(F.col("corporation_id").alias("id"), F.col("corporation_name").alias("name")).alias("company"))
    return listing.page_json(rows.select(body.alias("row")).select("row.*"))


def _escaped(text: F.Column) -> F.Column:
    """A text as it is written in markup; nothing for null."""
    out = F.coalesce(text, F.lit(""))
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def _shown(title: F.Column, link: F.Column, summary: F.Column) -> F.Column:
    return F.concat(F.lit("<div class='post'><h2><a href='"), _escaped(link), F.lit("'>"), _escaped(title), F.lit("</a></h2><p class='excerpt'>"), _escaped(summary), F.lit("</p></div>"))


#: A text as it is read from markup: nothing invisible, white space collapsed, none at the ends.
_READ = r"trim(regexp_replace(regexp_replace(coalesce({}, ''), '[\x{{200b}}\x{{ad}}]', '', 'g'), '[ \t\n\f\r\x{{a0}}]+', ' ', 'g'), ' ')"
_CUT = "CASE WHEN length({0}) > 200 THEN left({0}, 200) || '...' ELSE {0} END"


@query(f"""
SELECT corporation_id, link, title, {_CUT.format("summary")} AS summary, TIMESTAMP '{NOW}' AS published_at
FROM (SELECT corporation_id, link, {_READ.format("title")} AS title, {_READ.format("summary")} AS summary FROM article WHERE deleted_at IS NULL)
WHERE length(title) >= 5 AND link LIKE 'http%'""")
def page_extract(spark: SparkSession, folder: str) -> DataFrame:
    """All active articles written as pages of their company and read back by the default provider."""
    rows = table(spark, folder, "article").where(P.active()).select("corporation_id", "link", _shown(F.col("title"), F.col("link"), F.col("summary")).alias("html"))
    pages = rows.select("corporation_id", F.lit("https://blog.example").alias("blog_link"), F.col("link").alias("page_url"), F.lit("Default").alias("provider"), "html")
    return extract.settled(extract.raw_records(pages), _now()).select("corporation_id", "link", "title", "summary", "published_at")


@query(rf"""
SELECT corporation_id, link, title, {_CUT.format("summary")} AS summary, date_trunc('second', published_at) + INTERVAL 9 HOUR AS published_at
FROM (SELECT corporation_id, link, regexp_replace(coalesce(title, ''), '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g') AS title, {_READ.format("summary")} AS summary, coalesce(published_at, TIMESTAMP '2025-01-01') AS published_at FROM article WHERE deleted_at IS NULL)
WHERE length(title) >= 5 AND trim(link) <> ''""")
def feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    """All active articles written as feeds, one for each, with times in UTC, and read back in Korean time."""
    time = F.date_format(F.coalesce("published_at", F.lit("2025-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    item = F.concat(part("title", _escaped(F.col("title"))), part("link", _escaped(F.col("link"))), part("description", _escaped(_escaped(F.col("summary")))), part("pubDate", time))
    rows = table(spark, folder, "article").where(P.active()).select("corporation_id", F.col("link").alias("feed_url"), part("rss", part("channel", part("item", item))).alias("body"))
    return feeds.feed_records(rows, _now(), "Asia/Seoul").select("corporation_id", "link", "title", "summary", "published_at")


@query("""
SELECT id AS corporation_id, regexp_replace(blog_link, '/$', '') || CASE id % 3 WHEN 0 THEN '/feed' ELSE '/rss.xml' END AS feed_url
FROM corporation WHERE id % 3 < 2 AND deleted_at IS NULL AND trim(blog_link) <> ''""")
def feed_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first address of each blog whose feed has an entry, where others hold pages, broken feeds or empty ones."""
    full, empty, broken, page = (F.lit(x) for x in ("<rss><channel><item><title>A title</title><link>https://a</link></item></channel></rss>", "<rss><channel></channel></rss>", "<rss><item>", "<html></html>"))
    blogs = table(spark, folder, "corporation").where("deleted_at is null and trim(blog_link) <> ''")
    base, kind = X.without_slash(F.col("blog_link")), F.col("id") % 3
    stored = F.create_map(F.lit("/feed"), F.when(kind == 0, full).otherwise(empty), F.lit("/rss"), broken, F.lit("/feed.xml"), page, F.lit("/rss.xml"), F.when(kind < 2, full).otherwise(page), F.lit("/atom.xml"), F.when(kind < 2, full).otherwise(empty))
    bodies = blogs.select(base.alias("base"), F.explode(stored).alias("end", "body")).select(F.concat("base", "end").alias("url"), "body").groupBy("url").agg(F.max("body").alias("body"))
    return feeds.first_feed(feeds.candidates(blogs), bodies).select("corporation_id", "feed_url")


#: Ids of a source's articles, and of a page of its archive, in the archives that are written for the queries below.
_SOURCE, _BUCKET = 5000, 50
_ARCHIVED = f"""
WITH rows AS (
  SELECT id, corporation_id * 100000 + id // {_SOURCE} AS source, 'https://medium.com/s' || (corporation_id * 100000 + id // {_SOURCE}) || '/b' || (id // {_BUCKET}) AS page_url, link, {_READ.format("title")} AS title
  FROM article WHERE corporation_id IS NOT NULL
), items AS (SELECT * FROM rows WHERE title <> '' AND link LIKE 'http%'
), failed AS (SELECT DISTINCT source FROM items WHERE length(title) > 200 OR length(link) > 500
), good AS (SELECT * FROM items WHERE source NOT IN (SELECT source FROM failed)
), new AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY source, page_url, id) AS k FROM good)
  WHERE k = 1 AND link NOT IN (SELECT link FROM article WHERE deleted_at IS NULL AND id % 2 = 0 AND link IS NOT NULL)
)
"""


def _archives(spark: SparkSession, folder: str) -> ingest.Run:
    """A run over all articles, written as archives; those with even ids are known."""
    articles = table(spark, folder, "article")
    source = F.col("corporation_id") * 100000 + F.floor(F.col("id") / _SOURCE)
    blog = F.concat(F.lit("https://medium.com/s"), F.col("source"))
    item = F.concat(F.lit("<div class='postArticle' data-post-id='1'><a href='#'>1</a><a href='#'>2</a><a href='#'>3</a><a href='"), _escaped(F.col("link")), F.lit("'>4</a><h3>"), _escaped(F.col("title")), F.lit("</h3></div>"))
    rows = articles.where("corporation_id is not null").select("id", source.cast("bigint").alias("source"), F.floor(F.col("id") / _BUCKET).alias("bucket"), item.alias("item"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), "")  # at most _BUCKET ids
    buckets = rows.groupBy("source", "bucket").agg(html.alias("html")).withColumn("url", F.concat(blog, F.lit("/b"), F.col("bucket")))
    link = F.concat(F.lit("<div class='timebucket'><a href='"), F.col("url"), F.lit("'>x</a></div>"))
    indexes = buckets.groupBy("source").agg(F.array_join(F.collect_list(link), "").alias("html")).select(F.concat(blog, F.lit(ingest.ARCHIVE)).alias("url"), "html")  # at most _SOURCE / _BUCKET links
    none = F.lit(None)
    sources = rows.select("source").distinct().select(F.col("source").alias("id"), F.concat(F.lit("s"), F.col("source")).alias("name"), blog.alias("blog_link"), none.cast("timestamp_ntz").alias("deleted_at"))
    return ingest.ingest(sources, buckets.select("url", "html").unionByName(indexes), articles.where("id % 2 = 0"), _now())


@query(_ARCHIVED + "SELECT source AS corporation_id, title, link FROM new")
def archive_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return _archives(spark, folder).articles.select("corporation_id", "title", "link")


@query(
    _ARCHIVED
    + """SELECT s.source AS corporation_id, f.source IS NULL AS success, CASE WHEN f.source IS NOT NULL THEN 'title or link too long' END AS error_message,
  coalesce(n.n, 0)::INTEGER AS new_articles, coalesce(g.n, 0)::INTEGER AS extracted_articles
FROM (SELECT DISTINCT source FROM rows) s LEFT JOIN failed f ON s.source = f.source LEFT JOIN (SELECT source, count(*) AS n FROM new GROUP BY 1) n ON s.source = n.source
LEFT JOIN (SELECT source, count(*) AS n FROM good GROUP BY 1) g ON s.source = g.source"""
)
def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    return _archives(spark, folder).report.select("corporation_id", "success", "error_message", "new_articles", "extracted_articles")


def _companies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, folder, n) for n in ("corporation", "corporation_industry", "industry"))


_STATE = "count(*) FILTER (deleted_at IS NULL) AS active, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, max(name) FILTER (id = {0}) AS name, max(blog_link) FILTER (id = {0}) AS blog_link, strftime(max(updated_at) FILTER (id = {0}), '%Y-%m-%d %H:%M') AS updated"


def _state(rows: DataFrame, company: int) -> DataFrame:
    mine = F.col("id") == company
    own = lambda c: F.max(F.when(mine, F.col(c))).alias(c)
    return rows.agg(F.count_if(P.active()).alias("active"), F.count_if(~P.active()).alias("deleted"), own("name"), own("blog_link"), X.minute_text(F.max(F.when(mine, F.col("updated_at")))).alias("updated"))


@query(f"""
WITH added AS (SELECT * EXCLUDE (home_link, crew_link, logo_url) FROM corporation UNION ALL BY NAME
  SELECT (SELECT max(id) + 1 FROM corporation) AS id, 'A new company' AS name, 'https://new.example' AS blog_link, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at, NULL::TIMESTAMP AS deleted_at)
SELECT {_STATE.format("(SELECT max(id) FROM added)")}, 2::BIGINT AS industries FROM added""")
def corp_created(spark: SparkSession, folder: str) -> DataFrame:
    companies, links, industries = _companies(spark, folder)
    new, rows, bridge = C.create(companies, links, industries, C.CompanyForm("A new company", blog_link="https://new.example", industry_ids=[2, 5, 999]), datetime.fromisoformat(NOW))
    return _state(rows, new).withColumn("industries", F.lit(bridge.where(F.col("corporation_id") == new).count()).cast("bigint"))


@query(f"""
WITH changed AS (SELECT id, deleted_at, CASE WHEN id = 7 THEN 'Renamed' ELSE name END AS name, CASE WHEN id = 7 THEN NULL ELSE blog_link END AS blog_link, CASE WHEN id = 7 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM corporation)
SELECT {_STATE.format(7)}, 1::BIGINT AS industries FROM changed""")
def corp_updated(spark: SparkSession, folder: str) -> DataFrame:
    companies, links, industries = _companies(spark, folder)
    rows, bridge = C.update(companies, links, industries, 7, C.CompanyForm("Renamed", industry_ids=[3]), datetime.fromisoformat(NOW))
    return _state(rows, 7).withColumn("industries", F.lit(bridge.where("corporation_id = 7").count()).cast("bigint"))


@query(f"""
WITH changed AS (SELECT id, name, blog_link, CASE WHEN id = 7 THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at, CASE WHEN id = 7 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM corporation)
SELECT {_STATE.format(7)} FROM changed""")
def corp_deleted(spark: SparkSession, folder: str) -> DataFrame:
    return _state(C.soft_delete(_companies(spark, folder)[0], 7, datetime.fromisoformat(NOW)), 7)


@query("""
SELECT id, strftime(published_at, '%Y. %m. %d. ') || CASE WHEN hour(published_at) < 12 THEN '오전' ELSE '오후' END || strftime(published_at, ' %I:%M') AS tooltip FROM article WHERE published_at IS NOT NULL""")
def date_tooltip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article").where("published_at is not null").select("id", X.tooltip(F.col("published_at")).alias("tooltip"))
