"""Snapshots of tables: every change writes a new folder, then a pointer names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write a table as a new snapshot and point to it; the one that is being read stays as it is."""
    spark, version = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    files, pointer = _files(spark, f"{folder}/{name}.current")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    if files.exists(pointer):
        files.delete(pointer, False)
    files.rename(fresh, pointer)
    return version


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = spark.read.text(f"{folder}/{name}.current", wholetext=True).first()[0]
    return spark.read.parquet(f"{folder}/{version}")
