"""Session helpers: settings the operators rely on, shared scratch space, package shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the JSON functions and Python workers need and make the package importable in tasks.

    Duplicate JSON keys must resolve to the last one, as Python's parser does; the
    Spark default rejects such documents. Arrow batches are kept small, so that a Python worker's share of long texts is.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="shardloom-"), "shardloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("shardloom", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there every task
    sees the same disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = tempfile.mkdtemp(prefix="shardloom-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark itself resolves it on this driver.

    Tasks open files outside Spark's readers and writers by such URIs only, so driver and executors
    mean the same place. A mount point is followed to the store behind it.
    """
    jvm = spark.sparkContext._jvm
    given = jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = store.makeQualified(given)
    if store.getScheme() == "viewfs":
        parent = full.getParent()
        full = jvm.org.apache.hadoop.fs.Path(store.resolvePath(parent), full.getName())
    return full.toString()


def literal(path: str) -> str:
    """A path whose characters are not read as a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A path under the shared folder for as long as it is needed; what was written there is removed."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Used where one expensive result feeds several branches, or where a branch must see
    exactly the same rows on every attempt. A written table survives lost executors.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_parts(parts: Iterable[DataFrame], label: str = "stage") -> DataFrame:
    """Write frames of one schema one after the other to the shared folder and read them back as one.

    Used where a plan over everything would hold too much on the driver. While one is written the next one is asked for.
    """
    rest = iter(parts)
    part = next(rest, None)
    if part is None:
        raise ValueError("at least one part is needed")
    spark, schema = part.sparkSession, part.schema
    path = scratch_path(spark, label)
    with ThreadPoolExecutor(1) as ahead:
        while part is not None:
            coming = ahead.submit(next, rest, None)
            part.write.mode("append").parquet(path)
            part = coming.result()
            del coming
    return spark.read.schema(schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is proved to hold at most ``max_rows`` rows.

    A larger table is returned as it is, so the join falls back to a shuffle join that
    adaptive execution may split where a key is hot.
    """
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df
