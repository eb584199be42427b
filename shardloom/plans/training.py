"""Training and validation batches from samples or shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.captions import caption_en_first, caption_raw, pick_image
from shardloom.functions.text import utf8_ignore
from shardloom.functions.tokens import pad_tokens, whitespace_tokens
from shardloom.operators.dataset import BATCH_SIZE, TRAIN_RATIO, assign_batches, split_train_val, trainable
from shardloom.session import materialize
from shardloom.sources.tar import fetch_member, read_splits, shard_splits

# Fixed value: longest text input of the scoring model, in tokens.
TEXT_LENGTH = 64


def sample_pairs(samples: DataFrame, english: bool = True) -> DataFrame:
    """``url, key, image, caption`` of the samples that can be trained on."""
    choose = caption_en_first if english else caption_raw
    pairs = samples.select(
        "url", "key", pick_image(F.col("jpg"), F.col("png")).alias("image"),
        choose(F.col("json"), F.col("txt")).alias("caption"),
    )
    return trainable(pairs)


def _batched(
    pairs: DataFrame, drop_last: bool, batch_size: int, seed: int, max_len: int, shard: str = "url"
) -> DataFrame:
    batched = assign_batches(pairs, batch_size, partition=shard, seed=seed, drop_last=drop_last, tie=["caption"])
    tokens = batched.withColumn("tokens", whitespace_tokens(F.col("caption")))
    return pad_tokens(tokens, "tokens", [shard, "batch"], max_len, bounded=True)


def batches_from_samples(
    samples: DataFrame, ratio: float = TRAIN_RATIO, batch_size: int = BATCH_SIZE, seed: int = 0,
    max_len: int = TEXT_LENGTH, english: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows with ``batch, row_in_batch, tokens, padded``.

    The split looks at the key before anything else is computed. The last incomplete
    batch of a shard is dropped for training only.
    """
    train, val = split_train_val(samples, "key", ratio)
    return tuple(
        _batched(sample_pairs(part, english), last, batch_size, seed, max_len) for part, last in ((train, True), (val, False))
    )


def training_batches(
    spark: SparkSession, glob: str, ratio: float = TRAIN_RATIO, batch_size: int = BATCH_SIZE,
    seed: int = 0, max_len: int = TEXT_LENGTH, english: bool = True, on_error: str = "skip",
) -> tuple[DataFrame, DataFrame]:
    """Batches straight from tar shards.

    One pass reads the text members and notes where the images lie. Split, order, batches and padding
    are worked out on that narrow table. The image bytes are read last, by place, where the finished
    batches are, and go through no exchange. The tars of one ``source`` are one shard.
    """
    scanned = read_splits(shard_splits(spark, glob), ("json", "txt"), on_error, places=True)
    choose = caption_en_first if english else caption_raw
    jpg, png = F.col("places")["jpg"], F.col("places")["png"]
    json, txt = (utf8_ignore(F.col("fields")[f]) for f in ("json", "txt"))
    narrow = scanned.select("url", "source", "key", F.when(jpg["size"] > 0, jpg).otherwise(png).alias("image"), choose(json, txt).alias("caption"))
    usable = narrow.filter((F.col("image.size") > 0) & (F.length("caption") > 0))
    pairs = materialize(
        usable.select("url", "source", "key", "caption", F.col("image.at").alias("image_at"), F.col("image.size").alias("image_size")), "pairs"
    )
    train, val = split_train_val(pairs, "key", ratio)
    return tuple(
        fetch_member(_batched(part, last, batch_size, seed, max_len, "source"), "image_at", "image_size", "image")
        for part, last in ((train, True), (val, False))
    )
