"""Split, filter, shuffle and batch samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.captions import has_image
from shardloom.functions.hashing import split_score
from shardloom.operators.ordering import hash_buckets, number_rows

# Share of training samples and rows per training batch.
TRAIN_RATIO = 0.95
BATCH_SIZE = 256

# Slots of the shuffle buffer in training and in validation.
TRAIN_BUFFER = 1000
VAL_BUFFER = 250

# Pieces in which the rows of a shard are numbered.
BUCKETS = 256


def _check_ratio(ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError("ratio must lie strictly between 0 and 1")


def with_split(df: DataFrame, key: str = "key", ratio: float = TRAIN_RATIO) -> DataFrame:
    """Add ``split``: ``train`` below the ratio, else ``val``."""
    _check_ratio(ratio)
    return df.withColumn("split", F.when(split_score(F.col(key)) < ratio, "train").otherwise("val"))


def split_train_val(df: DataFrame, key: str = "key", ratio: float = TRAIN_RATIO) -> tuple[DataFrame, DataFrame]:
    """Two filters on the key alone, so they run before any payload is touched."""
    _check_ratio(ratio)
    score = split_score(F.col(key))
    return df.filter(score < ratio), df.filter(score >= ratio)


def trainable(df: DataFrame, image: str = "image", caption: str = "caption") -> DataFrame:
    """Samples with an image and a non-empty caption."""
    return df.filter(has_image(F.col(image)) & (F.length(caption) > 0))


def shuffle_digest(key: Column, seed: int) -> Column:
    """Reproducible shuffle order of a key under a seed, as a hex digest."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary"))


def shuffle(df: DataFrame, key: str = "key", seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Global reproducible shuffle: rows move by key hash and are ordered by it inside partitions."""
    digest = shuffle_digest(F.col(key).cast("string"), seed)
    moved = df.repartition(partitions, digest) if partitions else df.repartition(digest)
    return moved.sortWithinPartitions(digest)


def buffer_shuffle(
    df: DataFrame, order: list, bucket: Column, size: int = TRAIN_BUFFER, partition: str = "url", seed: int = 0
) -> DataFrame:
    """Add ``shard_order`` and ``position``: the order in which a buffer of ``size`` slots gives out each shard's rows.

    The first ``size`` rows of a shard, by ``order``, fill the slots. Each further row takes the slot drawn for it, and the row that was
    there is given out; in the end the slots are given out in drawn order. Shards come by ``shard_order``.
    A draw depends on the seed, the shard and the row's place in it, so the buffer need not be replayed: a row is
    given out when the next row is drawn to its slot, which is a window over one slot of one shard. ``bucket`` cuts
    shards into pieces that one task numbers, see ``number_rows``. Hand in keys and places only; payload would move with them. Ties of
    ``order`` leave the places of the tied rows open.
    """
    if size < 1:
        raise ValueError("the buffer needs a slot")
    shard = F.coalesce(F.col(partition).cast("string"), F.lit(""))

    def drawn(*what: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), shard, *what).cast("binary"))

    rows = number_rows(df, [partition], order, bucket, "__at", "__n")
    at = F.col("__at") - 1
    number = F.conv(F.substring(drawn(at.cast("string")), 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("__slot", F.when(at < size, at).otherwise(number % size))
    slot = Window.partitionBy(partition, "__slot").orderBy("__at")
    rows = rows.withColumn("__next", F.lead("__at").over(slot))
    gone = rows.filter("__next IS NOT NULL").withColumn("position", F.col("__next") - 1 - size)
    # At most ``size`` rows of a shard are left in the slots.
    end = Window.partitionBy(partition).orderBy(drawn(F.lit("end"), F.col("__slot").cast("string")), "__slot")
    first = F.col("__n") - F.least(F.col("__n"), F.lit(size))
    held = rows.filter("__next IS NULL").withColumn("position", first + F.row_number().over(end) - 1)
    both = gone.unionByName(held).withColumn("position", F.col("position").cast("bigint"))
    return both.withColumn("shard_order", drawn()).drop("__at", "__n", "__slot", "__next")


def assign_batches(
    df: DataFrame, size: int = BATCH_SIZE, key: str = "key", partition: str = "url",
    seed: int = 0, drop_last: bool = False, tie: list[str] | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``batch`` and ``row_in_batch``: consecutive rows of each shard in shuffle order.

    ``tie`` names further columns for keys that repeat. The digest covers them, so copies
    of one key spread over the ``buckets`` in which a shard is numbered.
    """
    identity = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *(tie or [])]])
    keyed = df.withColumn("__digest", shuffle_digest(identity, seed))
    bucket = hash_buckets(F.col("__digest"), buckets)
    out = number_rows(keyed, [partition], ["__digest"], bucket, "__at", "__n")
    pos = F.col("__at") - 1
    out = out.withColumn("batch", F.floor(pos / size).cast("bigint")).withColumn(
        "row_in_batch", (pos % size).cast("bigint")
    )
    if drop_last:
        out = out.filter((F.col("batch") + 1) * size <= F.col("__n"))
    return out.drop("__digest", "__at", "__n")
