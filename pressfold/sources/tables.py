"""Parquet tables of one data folder, read lazily with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressfold.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files; the executors get this package's code with it."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, properties: dict[str, str], split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a database; filters and columns are pushed down to it.

    ``split`` names a numeric column, its bounds and the number of parallel
    reads. The driver's jar must be on the class path; credentials come from the
    caller's environment.
    """
    ship(spark)
    if split is None:
        return spark.read.jdbc(url, name, properties=properties)
    column, low, high, parts = split
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
