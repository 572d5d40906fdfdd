"""From pages to new articles and a report of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressfold.functions.text import challenge_page, provider_of
from pressfold.operators.extract import raw_records, settled
from pressfold.operators.predicates import active, blank_link, crawlable, too_long
from pressfold.schemas import CRAWL_RESULT, LIMITS
from pressfold.session import stored
from pressfold.sources.pages import bucket_pages

NO_LINK = "no blog link"
CHALLENGE = "challenge page"
TOO_LONG = "title or link too long"
NOT_FETCHED = "page not fetched"
#: Fixed value: where an archive is, behind the blog's link.
ARCHIVE = "/archive"
_GATED = ("corporation_id", "corporation_name", "blog_link", "page_url", "provider", "html", "gate")
_REJECTS = "corporation_id bigint, page_url string, ordinal int, reject string"


def first_by_link(records: DataFrame) -> DataFrame:
    """Of records with the same link the first by source and place."""
    columns = [c for c in records.columns if c != "link"]
    best = records.groupBy("link").agg(F.min_by(F.struct(*columns), F.struct("corporation_id", "page_url", "ordinal")).alias("r"))
    return best.select("link", "r.*").select(*records.columns)


def unknown_links(records: DataFrame, articles: DataFrame) -> DataFrame:
    """Records whose link no active article has, whatever its source."""
    return records.join(articles.where(active()).select("link"), "link", "left_anti")


@dataclass
class Run:
    """New articles of a run, one report row for each of its sources, and the items that could not be read (corporation_id, page_url, ordinal, reject)."""

    articles: DataFrame
    report: DataFrame
    rejects: DataFrame


def with_ids(records: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """Article rows with ids that follow the largest one, in order of source and place."""
    start = articles.agg(F.max("id")).first()[0] or 0
    placed = stored(records.repartitionByRange("corporation_id", "page_url", "ordinal").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each partition
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("corporation_id", "page_url", "ordinal")))
    zero, none = F.lit(0), F.lit(None)
    return ranked.join(offsets, "part").select(
        (F.lit(start) + F.col("before") + F.col("rank")).alias("id"), "corporation_id", "title", "summary", "link", zero.alias("view_count"), zero.alias("like_count"), "thumbnail_image",
        none.cast("int").alias("reading_time"), "published_at", now.alias("created_at"), now.alias("updated_at"), none.cast("timestamp_ntz").alias("deleted_at"),
    )


def start_page() -> Column:
    """The page where a source is entered: an archive for Medium, else the blog itself."""
    blog = F.col("blog_link")
    return F.when(provider_of(blog) == "Medium", F.concat(blog, F.lit(ARCHIVE))).otherwise(blog)


def ingest(corporations: DataFrame, pages: DataFrame, articles: DataFrame, now: Column, *, enabled: bool = True, fetched_only: bool = False) -> Run:
    """Read the pages (url, html, optionally error: what went wrong when it was fetched, a time-out for instance) of all crawlable companies.

    A Medium source is entered at its archive, whose buckets lead to the pages
    with its records; the records of all buckets count, repeated or not. With
    ``fetched_only`` only companies take part whose start page is among the pages.
    A source fails as a whole if it has no link, a page of it was not fetched,
    asks to prove to be human or can't be parsed, or a record exceeds a limit.
    ``total_articles`` equals ``new_articles``; ``extracted_articles`` counts
    what the pages held.
    """
    sources = corporations.where(crawlable()).select(F.col("id").alias("corporation_id"), F.col("name").alias("corporation_name"), "blog_link")
    if not enabled:
        spark = corporations.sparkSession
        return Run(articles.limit(0), spark.createDataFrame([], CRAWL_RESULT), spark.createDataFrame([], _REJECTS))
    problem = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    fetched = pages.select(F.col("url").alias("page_url"), "html", problem.alias("fetch_error"))
    entered = sources.withColumn("page_url", start_page()).join(fetched, "page_url", "inner" if fetched_only else "left").withColumn("provider", provider_of(F.col("blog_link")))
    missing = F.when(F.col("html").isNull(), F.coalesce("fetch_error", F.lit(NOT_FETCHED)))
    gate = F.when(blank_link(), NO_LINK).when(missing.isNotNull(), missing).when(challenge_page(F.col("html"), F.col("page_url")), CHALLENGE)
    entered = entered.withColumn("gate", gate)
    indexes = (F.col("provider") == "Medium") & F.col("gate").isNull()
    buckets = bucket_pages(entered.where(indexes).drop("gate", "page_url"), fetched).withColumn("gate", gate)
    gated = stored(entered.where(~indexes).select(*_GATED).unionByName(buckets.select(*_GATED)))
    raw = stored(raw_records(gated.where("gate is null")))
    found = stored(settled(raw, now))
    shut = gated.where("provider = 'Medium' and gate is not null").select("corporation_id", F.col("gate").alias("error"))
    wrong = raw.where("error is not null").select("corporation_id", "error").unionByName(shut).unionByName(found.where(too_long({"title": LIMITS["article.title"], "link": LIMITS["article.link"]})).select("corporation_id", F.lit(TOO_LONG).alias("error")))
    failed = wrong.groupBy("corporation_id").agg(F.min("error").alias("error"))
    good = found.join(failed, "corporation_id", "left_anti")
    new = stored(unknown_links(first_by_link(good), articles))
    counts = new.groupBy("corporation_id").agg(F.count("*").alias("new_articles"))
    held = good.groupBy("corporation_id").agg(F.count("*").alias("extracted_articles"))
    rows = entered.groupBy("corporation_id", "corporation_name").agg(F.min("gate").alias("gate"), F.count_if(F.col("gate").isNull()).alias("readable"))
    report = rows.join(failed, "corporation_id", "left").join(counts, "corporation_id", "left").join(held, "corporation_id", "left")
    message = F.coalesce("error", F.when(F.col("readable") == 0, F.col("gate")))
    number = lambda c: F.coalesce(F.when(message.isNull(), F.col(c)), F.lit(0)).cast("int")
    report = report.select(
        "corporation_id", "corporation_name", message.isNull().alias("success"), message.alias("error_message"), now.alias("crawled_at"),
        number("new_articles").alias("total_articles"), number("new_articles").alias("new_articles"), number("extracted_articles").alias("extracted_articles"),
    )
    return Run(with_ids(new, articles, now), report, raw.where("reject is not null").select("corporation_id", "page_url", "ordinal", "reject"))


def ingest_one(company: int, corporations: DataFrame, pages: DataFrame, articles: DataFrame, now: Column) -> Run:
    """The same for one company; one that is unknown or deleted has no report."""
    return ingest(corporations.where(F.col("id") == company), pages, articles, now)


def append_articles(run: Run, path: str) -> None:
    """Append the new articles to the table's folder."""
    run.articles.write.mode("append").parquet(path)


def write_report(run: Run, path: str) -> None:
    """Append the report, a folder for each day of crawling."""
    run.report.withColumn("crawled_on", F.to_date("crawled_at")).write.mode("append").partitionBy("crawled_on").parquet(path)
