"""Counts of articles by company, recent activity and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.operators.predicates import crawlable


def articles_by_company(articles: DataFrame) -> DataFrame:
    """All articles of each company, deleted ones too."""
    return articles.groupBy("corporation_id").agg(F.count("*").alias("articles"))


def new_articles(articles: DataFrame, since: Column) -> DataFrame:
    """Articles of each company created at or after a time, deleted ones too."""
    return articles.where(F.col("created_at") >= since).groupBy("corporation_id").agg(F.count("*").alias("new_articles"))


def crawl_stats(corporations: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """One row: crawlable companies, their articles of the last day, and ``now``."""
    sources = corporations.where(crawlable()).select(F.col("id").alias("corporation_id"))
    since = now - F.expr("INTERVAL 1 DAY")
    fresh = articles.where(F.col("created_at") >= since).join(sources, "corporation_id", "left_semi")
    both = sources.select(F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(fresh.select(F.lit(0).alias("c"), F.lit(1).alias("a")))
    return both.agg(F.count_if(F.col("c") == 1).alias("total_corporations"), F.count_if(F.col("a") == 1).alias("total_new_articles")).withColumn("last_crawled_at", now)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: sources, successes, failures and new articles of the successes."""
    good = F.coalesce("success", F.lit(False))
    return results.agg(
        F.count("*").alias("sources"),
        F.count_if(good).alias("successes"),
        F.count_if(~good).alias("failures"),
        F.coalesce(F.sum(F.when(good, F.col("new_articles"))), F.lit(0)).alias("new_articles"),
    )


def run_failures(results: DataFrame) -> DataFrame:
    """Failures with the name of their source, ``Unknown`` if there is none."""
    failed = results.where(~F.coalesce("success", F.lit(False)))
    return failed.select("corporation_id", F.coalesce("corporation_name", F.lit("Unknown")).alias("corporation_name"), "error_message", "crawled_at")


def quality(articles: DataFrame) -> DataFrame:
    """One row: share of articles with a summary and with a date."""
    has_summary = F.coalesce(F.trim("summary") != "", F.lit(False)).cast("int")
    return articles.agg(F.count("*").alias("articles"), F.avg(has_summary).alias("with_summary"), F.avg(F.col("published_at").isNotNull().cast("int")).alias("with_date"))
