"""Shard translation from tars to tars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.captions import caption_for_translation
from shardloom.functions.json import set_json_string
from shardloom.functions.tokens import Tokenizer
from shardloom.operators.language import LanguageProfile
from shardloom.operators.translate import TextModel, translate_captions, usable_translation
from shardloom.session import materialize, scratch
from shardloom.sources.tar import (
    SPLIT_BYTES, list_shards, read_splits, rewrite_shards, spread_count, spread_splits, typed_samples,
)


def translate_samples(
    samples: DataFrame, profile: LanguageProfile, table: DataFrame, load_model: Callable[[str], TextModel],
    keys: list[str], default: str = "m_default", spread: int | None = None,
    cap: tuple[Callable[[], Tokenizer], int] | None = None, deal: int | None = None,
) -> DataFrame:
    """``json, txt`` samples with ``caption, translation, new_json`` in their place.

    ``keys`` must identify a sample. Other columns stay. Samples without a usable caption pass through with a
    null translation and unchanged JSON, in the same pass. ``spread`` or ``deal`` regroup the narrow rows for the models.
    """
    narrow = samples.withColumn("caption", caption_for_translation(F.col("json"), F.col("txt"))).drop("txt")
    done = translate_captions(narrow, profile, table, load_model, keys, "caption", default, spread=spread, cap=cap, deal=deal)
    translation = F.when(F.col("caption").isNotNull(), F.col("translation"))
    return done.withColumn("translation", translation).select(
        *[c for c in narrow.columns if c != "json"], "translation",
        set_json_string(F.col("json"), "caption_en", usable_translation(F.col("translation"))).alias("new_json"),
    )


def translate_files(
    files: DataFrame, out_dir: str, profile: LanguageProfile, table: DataFrame,
    load_model: Callable[[str], TextModel], default: str = "m_default", split_bytes: int = SPLIT_BYTES,
    spread: int | None = None, on_error: str = "fail", cap: tuple[Callable[[], Tokenizer], int] | None = None,
) -> DataFrame:
    """Translate the tars of ``url, length`` into ``out_dir`` and return the manifest.

    The first pass reads only the text members. The changed JSON, a narrow table, then
    meets the splits again, and the payload is copied from file to file. ``spread`` sets the
    number of tasks that call models, ``cap`` a tokenizer and how many tokens models are given. A broken tar stops the job, or with ``on_error='skip'``
    gives its samples up to there and a count of errors in the manifest.
    """
    splits = materialize(spread_splits(files, split_bytes), "splits")
    spark = splits.sparkSession
    scanned = splits.repartition(spread_count(spark, splits.count()))
    place = ["url", "part", "offset"]
    text = typed_samples(read_splits(scanned, ("json", "txt"), on_error)).select(*place, "json", "txt")
    with scratch(spark, "captions") as path:
        # The number is stored with the text, so every later step sees the same one.
        text = materialize(text.withColumn("sample_no", F.monotonically_increasing_id()), path=path)
        new = translate_samples(text, profile, table, load_model, ["sample_no"], default, spread, cap)
        changed = new.filter(usable_translation(F.col("translation")).isNotNull())
        return rewrite_shards(splits, changed.select(*place, F.col("new_json").alias("json")), out_dir, on_error)


def translate_shards(
    spark: SparkSession, in_glob: str | list[str], out_dir: str, profile: LanguageProfile, table: DataFrame,
    load_model: Callable[[str], TextModel], default: str = "m_default", split_bytes: int = SPLIT_BYTES,
    spread: int | None = None, on_error: str = "fail", cap: tuple[Callable[[], Tokenizer], int] | None = None,
) -> DataFrame:
    """Translate every tar of a glob, or of a list."""
    files = list_shards(spark, in_glob)
    return translate_files(files, out_dir, profile, table, load_model, default, split_bytes, spread, on_error, cap)
