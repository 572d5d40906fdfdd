"""Queries over incoming records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressfold.operators.timestamps import normalise_times
from pressfold.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_times(table(spark, folder, "crawled_article"), table(spark, folder, "source_zone"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found}
SQL: dict[str, str] = {}
