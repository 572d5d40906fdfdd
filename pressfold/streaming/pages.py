"""New page files, each read once: a file stream into ``ingest``, run to its end and restarted by a scheduler.

Only companies whose start page is in a batch are read and reported. Of several
versions of a page the newest by fetched_at counts, then by the file's time. The
index of an archive and its buckets belong in one batch.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.operators.ingest import ingest
from pressfold.schemas import PAGE


def newest(pages: DataFrame) -> DataFrame:
    """One row for each url: the version fetched last, without a time before those with one, then the file written last."""
    best = F.max_by(F.struct("html", "error"), F.struct("fetched_at", "written_at", "html", "error"))
    return pages.groupBy("url").agg(best.alias("page")).select("url", "page.*")


def scheduled(run: Callable[[], None], *, enabled: bool = True) -> bool:
    """One run of a schedule: an error is logged and the schedule goes on; what the run has not committed is read again by the next."""
    if not enabled:
        return False
    try:
        run()
    except Exception:
        logging.getLogger(__name__).exception("scheduled run failed")
        return False
    return True


def ingest_stream(
    spark: SparkSession, pages: str, checkpoint: str, catalogue: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame, DataFrame, int], None], *, files_per_batch: int = 1000
) -> None:
    """Read all page files that have come since the last call.

    ``catalogue`` gives the companies and articles as they are now; ``write``
    gets the new articles, the report and the batch's number, under which it
    must keep them, so that a batch that is repeated is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        companies, articles = catalogue()
        run = ingest(companies, newest(rows), articles, F.current_timestamp().cast("timestamp_ntz"), fetched_only=True)
        write(run.articles, run.report, number)

    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(pages).select("*", F.col("_metadata.file_modification_time").alias("written_at"))
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_links(records: DataFrame, delay: str = "7 days") -> DataFrame:
    """Of streamed records (link, published_at) the first of each link within the delay; state older than that is dropped."""
    return records.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["link"])
