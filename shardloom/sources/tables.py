"""Metadata export, dataset profile and sample export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: samples written by the export.
EXPORT_N = 50


def export_metadata(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def profile_dataset(df: DataFrame, key: str, caption: str, image: str | None = None) -> DataFrame:
    """One row: counts, nulls, first caption and first image by key, and the image size range.

    ``image`` is a struct column of Spark's image source.
    """
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(caption).isNull()).alias("null_captions"),
        F.min_by(caption, key).alias("first_caption"),
    ]
    if image:
        aggs += [
            F.count_if(F.col(image).isNull()).alias("null_images"),
            F.min_by(F.col(image)["nChannels"], F.when(F.col(image).isNotNull(), F.col(key))).alias("first_channels"),
            *[
                fn(F.col(image)[side]).alias(f"{label}_{side}")
                for side in ("height", "width")
                for fn, label in ((F.min, "min"), (F.max, "max"))
            ],
        ]
    return df.agg(*aggs)


def export_samples(
    df: DataFrame, key: str, image: Column, caption: Column, n: int = EXPORT_N
) -> DataFrame:
    """``name, image, caption`` of the first ``n`` samples by key, named ``sample_%05d.jpg``.

    The limit is the feature. Only ``n`` rows reach the numbering.
    """
    first = df.select(F.col(key).alias("__key"), image.alias("image"), caption.alias("caption"))
    first = first.orderBy("__key").limit(n)
    number = F.row_number().over(Window.orderBy("__key")) - 1
    return first.select(F.format_string("sample_%05d.jpg", number).alias("name"), "image", "caption")
