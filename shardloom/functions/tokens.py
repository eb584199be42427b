"""Token arrays cut and padded to a common length."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hooks import held
from shardloom.functions.text import BLANKS, py_strip, slices

# Tokens of a text that a translation model takes, and of a caption in training.
TRANSLATION_TOKENS = 128
CAPTION_TOKENS = 64

# Bytes and texts that a tokenizer is given at once; its tokens are Python objects until they are in Arrow columns.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 512

# Texts to, of each text, its token ids and the ends of the tokens in code points.
Tokenizer = Callable[[list[str]], list[tuple[list[int], list[int]]]]


def encoded_column(load_tokenizer: Callable[[], Tokenizer], length: int, pad_id: int = 0) -> Callable[[Column], Column]:
    """Column function of a text: ``ids`` and ``mask`` of exactly ``length``, ``n_tokens`` before the cut, and ``kept``.

    ``kept`` is the text up to the end of the last token that is left, the whole text if none is cut off. The mask has 1 for a token and 0
    for padding. Of a null text all are null. A worker process loads the tokenizer once and hands it
    about ``SLICE_BYTES`` of texts a time. Only the text crosses into Python.
    """
    if length < 1:
        raise ValueError("the length must be positive")
    hook = uuid.uuid4().hex

    def encoded(texts: pa.Array, tokenize: Tokenizer) -> pa.StructArray:
        given = texts.to_pylist()
        there = [i for i, text in enumerate(given) if text is not None]
        ids, mask = np.full((len(given), length), pad_id, np.int32), np.zeros((len(given), length), np.int32)
        counts: list = [None] * len(given)
        kept: list = [None] * len(given)
        for i, (found, ends) in zip(there, tokenize([given[i] for i in there]), strict=True):
            if len(found) != len(ends):
                raise ValueError("a tokenizer gives as many ends as ids")
            n = min(len(found), length)
            ids[i, :n], mask[i, :n], counts[i] = found[:n], 1, len(found)
            kept[i] = given[i][: ends[n - 1]] if len(found) > length else given[i]
        offsets = pa.array(np.arange(len(given) + 1, dtype=np.int32) * length)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel()), mask=texts.is_null()) for m in (ids, mask)]
        return pa.StructArray.from_arrays(
            [*lists, pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=["ids", "mask", "n_tokens", "kept"]
        )

    @F.arrow_udf("struct<ids:array<int>,mask:array<int>,n_tokens:bigint,kept:string>")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenize = held((hook, ""), load_tokenizer)
        for texts in batches:
            parts = [encoded(texts.slice(lo, hi - lo), tokenize) for lo, hi in slices(texts, SLICE_BYTES, SLICE_ROWS)]
            yield pa.concat_arrays(parts) if parts else encoded(texts, lambda _: [])

    return call


def whitespace_tokens(c: Column) -> Column:
    """Stand-in tokenizer: split on blanks. Any array column can take its place."""
    text = py_strip(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"{BLANKS}+"))


def pad_tokens(
    df: DataFrame,
    tokens: str,
    batch: list[str],
    max_len: int,
    mode: str = "longest",
    truncate: bool = True,
    pad: str = "[PAD]",
    bounded: bool = False,
) -> DataFrame:
    """Add ``n_tokens`` and ``padded``.

    ``longest`` pads to the longest row of the batch, ``max_length`` to ``max_len``.
    Rows longer than the target stay as they are when truncation is off. The longest
    length comes from a grouped maximum joined back, so no batch is gathered. ``bounded``
    says that batches have a proved size; then a window finds it, and the input, which
    may carry images, is neither computed nor shuffled twice.
    """
    if mode not in ("longest", "max_length"):
        raise ValueError(f"unknown padding mode: {mode}")
    cut = F.slice(F.col(tokens), 1, max_len) if truncate else F.col(tokens)
    out = df.withColumn("__cut", cut).withColumn("n_tokens", F.size("__cut").cast("bigint"))
    if mode == "longest" and bounded:
        out = out.withColumn("__width", F.max("n_tokens").over(Window.partitionBy(*batch)))
    elif mode == "longest":
        widths = out.groupBy(*batch).agg(F.max("n_tokens").alias("__width"))
        out = out.join(widths, batch)
    else:
        out = out.withColumn("__width", F.lit(max_len).cast("bigint"))
    missing = F.greatest(F.col("__width") - F.col("n_tokens"), F.lit(0)).cast("int")
    filler = F.array_repeat(F.lit(pad), missing)
    return out.withColumn("padded", F.concat("__cut", filler)).drop("__cut", "__width")
