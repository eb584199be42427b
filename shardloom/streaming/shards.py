"""Translate shards as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.language import LanguageProfile
from shardloom.operators.translate import TextModel
from shardloom.plans.translation import translate_files, translate_samples

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_translate(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, profile: LanguageProfile,
    table: DataFrame, load_model: Callable[[str], TextModel], default: str = "m_default",
    files_per_trigger: int | None = None, on_error: str = "fail", use_up: bool = False,
) -> StreamingQuery:
    """Translate each arriving tar once.

    The stream carries names and sizes only, so a shard may exceed the size of a row. Every
    batch has its own output folder ``batch=N``; a batch that is run again finds its
    manifest and is skipped, which makes the output exactly-once. With ``use_up`` the tars of a batch are removed
    when the next one begins, so that not everything is there twice.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.tar")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if use_up:
        reader = reader.option("cleanSource", "delete")
    arriving = reader.load(in_dir).select(F.col("path").alias("url"), "length")

    def handle(files: DataFrame, batch: int) -> None:
        try:
            translate_files(files, f"{out_dir}/batch={batch}", profile, table, load_model, default, on_error=on_error)
        except FileExistsError:
            pass

    return (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_translate_samples(
    samples: DataFrame, out_path: str, checkpoint: str, profile: LanguageProfile, table: DataFrame,
    load_model: Callable[[str], TextModel], keys: list[str], default: str = "m_default",
) -> StreamingQuery:
    """Translate a stream of Parquet samples into a Parquet table, one folder per batch."""

    def handle(part: DataFrame, batch: int) -> None:
        done = translate_samples(part, profile, table, load_model, keys, default)
        done.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    return (
        samples.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
