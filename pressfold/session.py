"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each context; the driver hands the archive out."""
    context = spark.sparkContext
    if _shipped.get("context") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pressfold-code-")
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, True)
    _shipped["context"] = context.applicationId


_shipped: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and
    the master is local, a temporary folder takes its place; a cluster without
    the setting is an error, since a machine's own folder would not survive.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pressfold-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = shared_folder(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read back: lineage ends, columns can be pruned.

    The files are removed when the session's Python process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``; only the keys are shuffled, and the rows of repeated ones."""
    repeated = stored(rows.groupBy(key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))


def new_folder(spark: SparkSession) -> str:
    """The path of a folder to be made in the shared folder; it is removed when the session's Python process ends."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if "://" not in path:
        path = f"file://{os.path.abspath(path)}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; nothing can be removed through it
        pass
