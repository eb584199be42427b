"""Loose image files."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.ml.image import ImageSchema
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import literal, materialize, materialize_parts, qualified, settings
from shardloom.sources.tar import locate


def _plain(path: Column) -> Column:
    """The path alone. Spark reports it with scheme and host, which a listed path of the same store may lack."""
    return F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?/*", "/")


# Parts of the image source that one task takes. A part is some 32 files, however small they are.
TASK_PARTS = 32
# Files that Spark lists on the driver at a time, where it keeps a kilobyte and more for each.
FILES_AT_ONCE = 60_000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_CACHE = "spark.sql.hive.filesourcePartitionFileCacheSize"
# Listed rows, narrow ones, that one broadcast may hold.
BROADCAST_ROWS = 100_000
# Names below a folder that Spark passes over, or does not give as they are written.
_PASSED_OVER = re.compile(r"(^|/)(\.|_(?!metadata|common_metadata)[^/=]*(/|$)|/|$)|\._COPYING_$")


def _decoded(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """Images of the given files, or of folders and those below, by plain path, in fewer and larger tasks than Spark makes."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(places)
    decoded = found.select(_plain(F.col("image.origin")).alias("__at"), "image")
    parts = decoded.rdd.getNumPartitions()
    return decoded.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-parts // TASK_PARTS)))


def _there(listed: DataFrame, base: str, root: str, path: str) -> DataFrame:
    """The listed rows whose file lies below ``base`` and is there, with its plain path and its place below as ``__at, __file``.

    ``base`` is the folder as Spark names it, ``root`` the URI by which tasks open it.
    """
    top = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?/*", "/", base).rstrip("/") + "/"
    named = listed.withColumn("__at", _plain(F.col(path))).withColumn("__file", F.col("__at"))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = locate(root)
        for batch in batches:
            # Spark reports a path as a URI, with some characters escaped.
            full = [unquote(p or "") for p in batch.column("__at").to_pylist()]
            names = [p[len(top) :] if p.startswith(top) and not _PASSED_OVER.search(p[len(top) :]) else None for p in full]
            wanted = [n for n in names if n is not None]
            found = store.get_file_info([f"{folder.rstrip('/')}/{n}" for n in wanted])
            there = {n for n, info in zip(wanted, found) if info.type == pafs.FileType.File}
            batch = batch.set_column(batch.schema.get_field_index("__file"), "__file", pa.array(names, pa.string()))
            yield batch.filter(pa.array([n in there for n in names], pa.bool_()))

    return named.mapInArrow(look, named.schema)


def image_parts(
    spark: SparkSession, listed: DataFrame, directory: str, path: str = "path", files_at_once: int = FILES_AT_ONCE
) -> Iterator[DataFrame]:
    """The listed images that decode, as ``read_images`` gives them, a bounded number of files at a time.

    Tasks look which listed files are there. Spark's image source then gets the names of ``files_at_once`` of them at most, so the driver
    holds that of two frames at most, however many files a folder has, where a frame is done with before the next but one is asked for.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if literal(directory) != directory or not store.exists(hadoop):
        # A pattern is listed as a whole; a folder that is missing is Spark's error.
        decoded = _decoded(spark, directory)
        yield listed.join(decoded, _plain(F.col(path)) == F.col("__at")).drop("__at")
        return
    base = store.makeQualified(hadoop).toString().rstrip("/")
    there = materialize(_there(listed, base, qualified(spark, directory), path), "listed-images")
    total = there.count()
    # Parts of two thirds, as ranges are cut by a sample.
    n = 1 if total <= files_at_once else -(-3 * total // (2 * files_at_once))
    there = materialize(there.repartitionByRange(n, "__file").withColumn("__part", F.spark_partition_id()), "image-parts")
    sizes = sorted(tuple(r) for r in there.groupBy("__part").count().collect())
    for part, size in sizes:
        rows = there.filter(F.col("__part") == part)
        # A name that is listed as it is and as a URI is one file.
        names = sorted(r[0] for r in rows.select("__file").distinct().collect())
        named = rows.drop("__file", "__part")
        for lo in range(0, len(names), files_at_once):
            some = [literal(f"{base}/{name}") for name in names[lo : lo + files_at_once]]
            # Few tasks list the files, and what they find is not kept beyond the frame.
            tasks = str(4 * spark.sparkContext.defaultParallelism)
            with settings(spark, {LISTING_TASKS: tasks, LISTING_CACHE: "0"}):
                decoded = _decoded(spark, some)
            joined = decoded.join(F.broadcast(named) if size <= BROADCAST_ROWS else named, "__at")
            yield joined.select(*listed.columns, "image")
            # What earlier frames hold on the driver goes when Python lets go of them.
            gc.collect()
    if not sizes:
        none = F.lit(None).cast(ImageSchema.columnSchema.simpleString())
        yield listed.filter(F.lit(False)).withColumn("image", none)


def _whole(parts: Iterator[DataFrame], label: str) -> DataFrame:
    """One frame as it is, several stored."""
    held = [next(parts)]
    held += [p for p in (next(parts, None),) if p is not None]
    if len(held) == 1:
        return held[0]

    def each() -> Iterator[DataFrame]:
        while held:
            yield held.pop(0)
        yield from parts

    return materialize_parts(each(), label)


def read_images(
    spark: SparkSession, listed: DataFrame, directory: str, path: str = "path", image: Column | None = None,
    files_at_once: int = FILES_AT_ONCE,
) -> DataFrame:
    """The listed images that decode, with their listed ids and an ``image`` struct.

    An unreadable or missing file drops its own row and moves no other id. ``image`` is what is kept of the struct. Of more files than
    ``files_at_once`` that is stored; to work on the pixels of many without storing them, go by ``image_parts``.
    """
    kept = F.col("image") if image is None else image
    parts = image_parts(spark, listed, directory, path, files_at_once)
    return _whole((p.withColumn("image", kept) for p in parts), "images-read")


def unreadable_images(
    spark: SparkSession, listed: DataFrame, directory: str, path: str = "path", files_at_once: int = FILES_AT_ONCE
) -> DataFrame:
    """Listed images that are missing or do not decode."""
    at = _plain(F.col(path)).alias("__at")
    names = listed.select(path)
    read = _whole((p.select(at) for p in image_parts(spark, names, directory, path, files_at_once)), "images-read")
    return listed.join(read, _plain(F.col(path)) == F.col("__at"), "left_anti")
