"""Pages as rows of url and html."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pressfold.operators.extract import bucket_links


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one page each, named by their path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def bucket_pages(index_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Second level of an archive: the index rows' columns with page_url and html of the pages they link to; html is null if a page is missing."""
    links = F.pandas_udf(lambda html: html.map(lambda h: bucket_links(h or "")), ArrayType(StringType()))
    wanted = index_pages.withColumn("page_url", F.explode(links("html"))).drop("html", "fetch_error")
    return wanted.join(pages, "page_url", "left")
