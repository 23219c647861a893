"""Sessions: sensible settings for local use, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tables up to this size may lie in one piece, and are dealt out over all cores before costly steps.
SPREAD_BYTES = 64 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: once per application, as a zip that Spark distributes."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="recollect-ship-"), "recollect.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(where)
    _SHIPPED.add(app)


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """``df``, dealt out over all cores if it is so small that it may be a single piece of a file.

    A larger table is left as it is: its files have pieces enough, and its rows would be moved for nothing.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= most else df


def bounded(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose rows' sizes add up to ``most`` at most, or single rows: what a task unpacks at once."""
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def staging_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one that ``spark.checkpoint.dir`` names; a temporary one only where unset, on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what several parts of a plan read is computed once, and survives lost executors."""
    folder = staging_dir(df.sparkSession)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove a folder when the driver ends: results are lazy, so the tables that they read must live as long as they may be asked for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def release(spark: SparkSession) -> None:
    """Remove every table that :func:`staged` left for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("recollect")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
