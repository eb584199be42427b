"""What the operators of this subpackage share: the learning split, bounded samples, plain words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import prepare

# A-Z to a-z; every other ASCII byte that is no letter or digit to a blank; bytes of other characters stay.
PLAIN_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

SAMPLE_GRAIN = 1 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """``prepare``, and Arrow batches that keep a Python worker's share of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return prepare(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray(b"")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of the id as text leaves 2 when divided by 4.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bounded_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` at the most, chosen by a hash of ``key``; all rows if there are no more.

    For fitting models on a documented number of labelled rows. The choice depends on the
    keys alone, so every attempt of a task makes the same one. Keys must be distinct; the number
    of rows is then binomial, and twice ``most`` is out of reach.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(SAMPLE_GRAIN * most / n)
    return df.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(SAMPLE_GRAIN)) < share)


def labelled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """``doc_id, label`` of labelled rows outside the held-out part, one per document, at most about ``most``.

    Rows without id or label teach nothing. Where the labels of one document differ, the higher counts.
    """
    rows = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    return bounded_rows(rows, "doc_id", most)


def give_back() -> None:
    """Return memory that this worker holds but does not use; a worker lives on for tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gives_back(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same scan; at its end the worker gives back memory."""

    @wraps(scan)
    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        give_back()

    return run
